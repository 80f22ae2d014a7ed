"""Places in an order within groups of any size, without a window over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tenurelens.operators.joins import lookup_join
from tenurelens.sources.workspace import settle, settle_lookup


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, in the ascending order of ``order`` within their group; equal rows in any order.

    Rows are dealt out by ranges of (group, order), equal ones too, and counted per range; a
    window sees one row per range and group. The ranges are sampled first, so ``rows`` should be
    a written table.
    """
    keys = [*group, *order]
    salted = rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(*keys, "__salt").sortWithinPartitions(*keys).drop("__salt")
    numbered = ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    table = settle(numbered, "ranges")
    runs = table.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*group, "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = lookup_join(table, settle_lookup(runs, "runs"), [*group, "__part"])
    return joined.select(*rows.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias(name))
