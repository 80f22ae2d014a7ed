"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenurelens.sources.workspace import remove, scratch_path, settle_at


def _lowest(links: DataFrame) -> DataFrame:
    """(u, v, m) for both directions of each link; m is the least of u and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns (node, component) for each node of ``links`` (a, b); the component is its least node.

    Large-star and small-star steps in turn: every node hands its larger neighbours, then
    its smaller ones, to the least node it knows, until every link points at a
    component's least node. Minima are combined before the shuffle, and the join back is
    between the links and one row per node, so AQE can split a node with very many
    links. Each round is a table in the shared folder and takes the place of the one before. Links with a NULL end and links
    from a node to itself are ignored.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    spark, before = links.sparkSession, None
    path = scratch_path(spark, "links")
    links = settle_at(links, path)
    for _ in range(rounds):
        large = _lowest(links).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # every link now runs from a larger node a to a smaller one b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        links = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        done, path = path, scratch_path(spark, "links")
        links = settle_at(links.distinct(), path)
        remove(spark, done)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select("b", "b").distinct().toDF("node", "component")
    )
