"""Mixing sources to target weights: whole copies by the repetition rate, one more by a hashed draw.

Sizes are added up per source, a target is derived for each source, and each document is
emitted floor(rate) times and once more with probability rate - floor(rate), drawn from a
hash of its identifier, so that every rerun draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenurelens.operators.joins import lookup_join
from tenurelens.sources.workspace import settle, settle_lookup

WORD = r"[^\x20\x09-\x0D]+"
#: The most copies of any document.
MOST = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the given weights in turn by code point of ``source``, NULL last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place - 1) % len(weights) + 1))


def source_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size, weight).

    The targets share the sum of all sizes by weight; none exceeds ``most`` times its
    source's size, and the excess goes to the others by weight until none is above. That
    is a level L with target = min(most * size, L * weight): with sources in
    order of cap / weight, L is the largest of the levels that arise when
    all sources before one are at their caps.
    """
    cap = F.col("source_size") * most
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = sources.withColumn("__level", left.cast("double") / weight.cast("double"))
    level = F.max("__level").over(every)
    return levels.withColumn("target", F.least(cap.cast("double"), level * F.col("weight"))).drop("__level")


def _copies(key: Column, seed: str) -> Column:
    """Copies of a document: the whole part of __rate, and one more by the draw."""
    digest = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    draw = F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor("__rate")
    return (whole + (draw < F.col("__rate") - whole).cast("long")).cast("long")


def _rated(docs: DataFrame, source: str, sources: DataFrame) -> DataFrame:
    table = sources.select(
        F.col("source").alias("__source"),
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"),
    )
    return lookup_join(docs, settle_lookup(table, "source-rates"), [(source, "__source")])


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """One row per source of ``sized`` (source, size): source_size, weight, target."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return source_targets(cyclic_weights(total), most)


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What the mix takes of each document: key, size, source_size, target, copies, taken.

    ``size`` counts words of the whole text. NULL text has size 0 and is never more than
    empty; a NULL source is a source of its own; a NULL key draws as the empty
    key does. Repeated rows are drawn alike. An empty table gives an empty report.
    """
    sized = settle(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes"
    )
    rated = _rated(sized, "source", targets(sized))
    copies = _copies(F.col("key"), SEED)
    return rated.select(
        F.col("key").alias(key),
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its draw says, with its columns unchanged."""
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rated = _rated(docs, source, targets(sized)).withColumn("__copies", _copies(F.col(key), SEED)).where("__copies > 0")
    return rated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "copies", "taken"
    )


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), total as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighted as (
  select *, (row_number() over (order by source asc nulls last) - 1) % 3 + 1 as weight from total
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0))::double as level
  from weighted window o as (order by 3 * source_size / weight asc, source asc nulls last)
), rated as (
  select source, source_size, least((3 * source_size)::double, max(level) over () * weight) as target from levels
), drawn as (
  select doc_id, size, source_size, target,
    case when source_size > 0 then target / source_size else 0.0 end as rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0 as u
  from sized join rated on sized.source is not distinct from rated.source
), counted as (
  select *, (floor(rate) + (case when u < rate - floor(rate) then 1 else 0 end))::bigint as copies from drawn
)
select doc_id, size, source_size, target, copies, size * copies as taken from counted
"""
