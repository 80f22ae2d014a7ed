"""Intermediate tables in the cluster's shared folder.

A frame that several steps read is written once as parquet and read back:
the lineage ends there, a lost executor costs one re-read, and every reader
prunes its own columns.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import cache
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"
#: Whether a query's shuffle files go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; only local mode may make its own."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {SETTING} to a folder every executor can reach")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tenurelens-")


_RUN: ContextVar[str] = ContextVar("run", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tenurelens/{_RUN.get()}{uuid.uuid4().hex}/{name}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """All intermediate tables made inside lie in one folder, which is removed at the end, also after a failure.

    Frames that read them must not be used afterwards.
    """
    run = f"run-{uuid.uuid4().hex}/"
    token = _RUN.set(run)
    folder = f"{shared_folder(spark)}/tenurelens/{run}"
    try:
        yield folder
    finally:
        _RUN.reset(token)
        remove(spark, folder)


def _files(spark: SparkSession, path: str):
    """A Hadoop path and its file system, whichever that is."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    found, system = _files(spark, path)
    system.delete(found, True)


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """``new`` takes the place of ``path``; should that fail, what stood there is put back."""
    source, system = _files(spark, new)
    target, _ = _files(spark, path)
    old, _ = _files(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    stood = system.exists(target)
    if stood and not system.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not system.rename(source, target):
        if stood:
            system.rename(old, target)
        raise OSError(f"{new} can't be moved to {path}")
    if stood:
        system.delete(old, True)


_TIDYING: dict[str, tuple[int, str | None]] = {}
_LOCK = Lock()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind; otherwise they stay until the driver happens to collect its garbage.

    For results that are not computed a second time from the same frame. Threads may be inside at once; the last one out
    restores the session's setting.
    """
    session = spark._jsparkSession.sessionUUID()
    with _LOCK:
        inside, before = _TIDYING.get(session) or (0, spark.conf.get(CLEANUP, None))
        _TIDYING[session] = inside + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            inside, before = _TIDYING.pop(session)
            if inside > 1:
                _TIDYING[session] = inside - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def settle_at(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """``settle`` to a path of its own, by which the table can be removed before its run ends."""
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with tidy(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return a frame over the written table."""
    return settle_at(df, scratch_path(df.sparkSession, name), partition_by)


def settle_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``settle`` for the frame that ``make`` returns; all tables that ``make`` has written on the way are removed.

    Only that frame may read them.
    """
    path = scratch_path(spark, name)
    with run_folder(spark):
        return settle_at(make(), path)


def settle_measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """``settle``, and aggregates of the written rows, which read the metrics' columns only; a sum over no rows is 0.

    Not by ``DataFrame.observe``: a session that has observed once can't ship a fitted forest to its
    tasks any more, because the forest's summary drags the session's observations along.
    """
    table = settle(df, name)
    found = table.agg(*[m.alias(k) for k, m in metrics.items()]).first()
    return table, {k: found[k] or 0 for k in metrics}


@dataclass(frozen=True)
class Lookup:
    """A written lookup table together with its measured number of rows and of bytes, about."""

    frame: DataFrame
    rows: int
    bytes: int = 0


def settle_lookup(df: DataFrame, name: str) -> Lookup:
    table = settle(df, name)
    texts = [c for c, kind in table.dtypes if kind == "string"]
    chars = [F.sum(F.octet_length(F.col(f"`{c}`"))) for c in texts]
    rows, *lengths = table.agg(F.count(F.lit(1)), *chars).first()
    return Lookup(table, rows, sum(n or 0 for n in lengths) + 16 * rows * len(table.columns))
