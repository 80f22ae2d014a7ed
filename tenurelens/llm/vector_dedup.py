"""Near-duplicate vectors of a label, by tiled comparison in the order of principal components.

Unit vectors are turned to the axes of a principal component analysis, the widest first. Vectors
whose cosine reaches the threshold are close on every axis, so a grid over the first axes
leaves only neighbouring cells to compare; large cells are split into tiles, and each
pair of tiles is a task. In a tile pair the products of the leading components are added
up in steps, and a pair is given up when the lengths of what is left of both vectors
cannot lift its cosine to the threshold. What remains is measured on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenurelens.llm.components import connected_components
from tenurelens.llm.vectors import matrix, sampled, usable
from tenurelens.sources.workspace import settle


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    #: Axes of the grid.
    axes: int = 2
    #: Vectors of a tile.
    tile: int = 1024
    #: Components added up in the first step; each further step doubles them.
    leading: int = 8
    #: Bound of the sample the axes are fitted on. Any axes give the same result.
    sample: int = 16_384
    seed: int = 5


def principal_axes(x: np.ndarray) -> np.ndarray:
    """Orthonormal columns by falling second moment of the unit rows of ``x``."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, vectors = np.linalg.eigh(unit.T @ unit)
    return vectors[:, ::-1].copy()


def _placed(axes: np.ndarray, grid: int, cell: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["vector"], len(axes))
            y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[:, :grid]
            cells = np.floor(y / cell).astype(np.int32)
            at = [pa.array(cells[:, i] if i < cells.shape[1] else np.zeros(len(x), np.int32)) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *at], [*batch.schema.names, "c0", "c1"])

    return run


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, same: bool, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` whose cosine reaches the threshold; of equal tiles each pair once."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ya, yb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    width, least = axes.shape[1], s.threshold - 1e-9
    # length of what comes behind the first k components
    rest_a, rest_b = (np.sqrt(np.maximum(np.cumsum((y**2)[:, ::-1], axis=1)[:, ::-1], 0)) for y in (ya, yb))
    rest_a, rest_b = (np.concatenate([r, np.zeros((len(r), 1))], axis=1) for r in (rest_a, rest_b))
    found = []
    for start in range(0, len(a), 64):
        k = min(s.leading, width)
        strip = slice(start, start + 64)
        part = ya[strip, :k] @ yb[:, :k].T
        i, j = np.nonzero(part + rest_a[strip, k, None] * rest_b[None, :, k] >= least)
        total, i = part[i, j], i + start
        if same:
            upper = i < j
            i, j, total = i[upper], j[upper], total[upper]
        while k < width and len(i):
            more = min(2 * k, width)
            total = total + np.einsum("nd,nd->n", ya[i, k:more], yb[j, k:more])
            keep = total + rest_a[i, more] * rest_b[j, more] >= least
            i, j, total, k = i[keep], j[keep], total[keep], more
        exact = np.einsum("nd,nd->n", a[i], b[j]) / (na[i] * nb[j]) >= s.threshold
        found.append((i[exact], j[exact]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component, for links a-b among ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _linked(axes: np.ndarray, s: Settings):
    def run(table: pa.Table) -> pa.Table:
        # the order of rows after a shuffle doesn't matter to the links found
        first = table["side"].to_numpy()
        same = bool(table["own"][0].as_py())
        rows, x = table["row"].to_numpy(), matrix(table["vector"], len(axes))
        at_a = np.arange(len(rows)) if same else np.flatnonzero(first == 0)
        at_b = at_a if same else np.flatnonzero(first == 1)
        i, j = close_pairs(x[at_a], x[at_b], axes, same, s) if len(at_a) and len(at_b) else (np.zeros(0, np.int64),) * 2
        i, j = at_a[i], at_b[j]
        links = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
        least = spanning(len(rows), i, j)
        linked = np.flatnonzero(links)
        return pa.table({"row": pa.array(rows[linked], pa.int64()), "links": pa.array(links[linked], pa.int64()), "other": pa.array(rows[least[linked]], pa.int64())})

    return run


def _tasks(placed: DataFrame, s: Settings) -> DataFrame:
    """Every row once for each pair of tiles that its tile takes part in."""
    at = ["label", "c0", "c1"]
    cells = placed.groupBy(*at).agg(F.ceil(F.count("*") / s.tile).cast("int").alias("tiles"))
    cells = settle(cells, "cells")
    ahead = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = cells.withColumn("d", F.explode(ahead)).select(
        "label", "c0", "c1", F.col("tiles").alias("tiles_a"), (F.col("c0") + F.col("d.x")).alias("o0"), (F.col("c1") + F.col("d.y")).alias("o1")
    )
    pairs = near.join(cells.toDF("label", "o0", "o1", "tiles_b"), ["label", "o0", "o1"])
    pairs = settle(pairs.withColumn("own", (F.col("c0") == F.col("o0")) & (F.col("c1") == F.col("o1"))), "cell-pairs")
    tile = F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")

    def upto(a, b):
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    zero = F.lit(0)
    as_a = placed.join(pairs.withColumn("tiles", F.col("tiles_a")), at).withColumn("ta", tile)
    as_a = as_a.withColumn("tb", F.explode(upto(F.when(F.col("own"), F.col("ta")).otherwise(zero), F.col("tiles_b") - 1))).withColumn("side", zero)
    turned = pairs.select("label", F.col("o0").alias("c0"), F.col("o1").alias("c1"), F.col("c0").alias("o0"), F.col("c1").alias("o1"), "tiles_a", "tiles_b", "own")
    as_b = placed.join(turned.withColumn("tiles", F.col("tiles_b")), at).withColumn("tb", tile)
    as_b = as_b.withColumn("ta", F.explode(upto(zero, F.when(F.col("own"), F.col("tb")).otherwise(F.col("tiles_a")) - 1))).withColumn("side", F.lit(1))
    out = ["label", "a0", "a1", "ta", "b0", "b1", "tb"]
    one = as_a.select("label", F.col("c0").alias("a0"), F.col("c1").alias("a1"), "ta", F.col("o0").alias("b0"), F.col("o1").alias("b1"), "tb", "side", "own", "row", "vector")
    two = as_b.select("label", F.col("o0").alias("a0"), F.col("o1").alias("a1"), "ta", F.col("c0").alias("b0"), F.col("c1").alias("b1"), "tb", "side", "own", "row", "vector")
    return one.union(two).withColumn("own", F.col("own") & (F.col("ta") == F.col("tb"))).select(*out, "side", "own", "row", "vector")


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", settings: Settings = Settings()
) -> DataFrame:
    """One row per row of ``vectors``: the key, n_links, component_id, kept.

    Rows link when their labels are equal and not NULL and the cosine of their vectors is at least
    the threshold, in double precision. Vectors that are NULL or zero or hold NULL or non-finite
    components link with nothing. Shorter vectors are read as ending in zeros. The component is named
    by its least key that isn't NULL; a row with that key is kept. Rows that repeat a key
    are rows of their own, and links between them count.
    """
    s = settings
    kind = vectors.schema[column].dataType.simpleString()
    base = settle(
        vectors.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(column).alias("vector")
        ),
        "vectors",
    )
    rows = base.where(F.col("label").isNotNull() & usable(F.col("vector"))).select("row", "label", "vector")
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    plain = base.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return plain
    some = sampled(rows, "row", "vector", n, width, s.sample, s.seed)
    axes = principal_axes(some) if len(some) else np.eye(width)
    # unit vectors at the threshold are at most this far apart, on any axis
    cell = float(np.sqrt(max(2 - 2 * s.threshold, 0)) + 1e-6)
    label_kind = rows.schema["label"].dataType.simpleString()
    placed = settle(
        rows.mapInArrow(_placed(axes, min(s.axes, 2, width), cell), f"row long, label {label_kind}, vector {kind}, c0 int, c1 int"), "placed"
    )
    by = ["label", "a0", "a1", "ta", "b0", "b1", "tb"]
    found = settle(_tasks(placed, s).groupBy(*by).applyInArrow(_linked(axes, s), "row long, links long, other long"), "links")
    counts = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    joined = connected_components(found.select(F.col("row").alias("a"), F.col("other").alias("b")))
    members = settle(base.select("row", "key").join(joined, F.col("row") == F.col("node")).select("row", "key", "component"), "members")
    least = members.groupBy("component").agg(F.min("key").alias("component_id"))
    named = members.join(least, "component").select("row", "component_id").join(counts, "row")
    out = base.select("row", "key").join(named, "row", "left")
    component = F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with usable as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b
    on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93
), counted as (
  select a, count(*) as n from links group by a
), reach as (
  with recursive r(a, b) as (select a, b from links union select r.a, links.b from r join links on r.b = links.a)
  select a, min(b) as least from r group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(least, vec_id)) as component_id,
  vec_id = least(vec_id, coalesce(least, vec_id)) as kept
from embeddings left join counted on vec_id = counted.a left join reach on vec_id = reach.a
"""
