"""Row numbers that stay the same on every read of a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from tenurelens.sources.workspace import settle

ROW = "__row"
#: Rows of a file have numbers below this.
_FILE = 1 << 40


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, a unique long: the number of a row's file and its place in the file.

    Neither follows how a scan is split, which changes with the executors at hand. A frame
    that isn't read from files is written first. One row per file is all that is broadcast.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        docs = settle(docs, "documents")
    paths = docs.select(F.col("_metadata.file_path").alias("__file")).distinct()
    number = F.row_number().over(Window.orderBy("__file")).cast("long")
    files = F.broadcast(settle(paths.withColumn("__number", number), "files"))
    placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    return placed.join(files, "__file").withColumn(ROW, F.col("__number") * _FILE + F.col("__index")).select(*docs.columns, ROW)
