"""Column summaries: what a column holds, what it lacks, and how its values are spread.

Numbers and dates get extremes, mean and quartiles, texts their distinct values and the most frequent one. Quartiles come from
mergeable sketches, one per task, column and sum of tasks, which are merged in two steps, so
that no column is gathered and no task merges the sketches of all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tenurelens.functions.nullsafe import DECIMALS, INFINITY, fixed_parts, from_parts, known

#: Size of a sketch; with it a quartile's rank is off by ``RANK_ERROR`` of the rows at most, with a confidence of 99 %.
SKETCH = 4096
RANK_ERROR = 0.0013
QUARTILES = (0.25, 0.5, 0.75)
#: Groups in which the tasks' sketches are merged before they are merged into one.
GROUPS = 64
NUMBER, DATE, TEXT = "number", "date", "text"


def kind_of(field: T.StructField) -> str:
    if isinstance(field.dataType, T.DateType):
        return DATE
    return NUMBER if isinstance(field.dataType, T.NumericType) else TEXT


def _number(field: T.StructField) -> Column:
    """The value as a double: dates by days since 1970-01-01, NaN as missing."""
    c = F.col(f"`{field.name}`")
    return F.unix_date(c).cast("double") if kind_of(field) == DATE else known(c.cast("double"))


def _measures(c: Column, decimals: int) -> dict[str, Column]:
    """Aggregates that add up, named with the aggregate that adds them up. The sum runs in fixed point, as in ``strict_avg``."""
    finite = F.when(F.abs(c) < INFINITY, c)
    high, low = fixed_parts(finite, decimals)
    return {
        "known_sum": F.count(c),
        "high_sum": F.sum(high),
        "low_sum": F.sum(low),
        "above_sum": F.count_if(c == INFINITY),
        "below_sum": F.count_if(c == -INFINITY),
        "least_min": F.min(c),
        "most_max": F.max(c),
        "sketch_kll": F.kll_sketch_agg_double(c, SKETCH),
    }


def _merged(name: str, c: Column) -> Column:
    merge = {"sum": F.sum, "min": F.min, "max": F.max, "kll": lambda s: F.kll_merge_agg_double(s, SKETCH)}
    return merge[name.rpartition("_")[2]](c)


def _mean(s: Column, decimals: int) -> Column:
    finite = from_parts(s["high_sum"], s["low_sum"], decimals) / s["known_sum"]
    both = (s["above_sum"] > 0) & (s["below_sum"] > 0)
    return (
        F.when(both | (s["known_sum"] == 0), None)
        .when(s["above_sum"] > 0, INFINITY)
        .when(s["below_sum"] > 0, -INFINITY)
        .otherwise(finite)
    )


def number_summary(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """One row per number or date column: rows, nulls, extremes, mean, quartiles."""
    fields = [f for f in df.schema.fields if kind_of(f) != TEXT]
    measured = {f"{i}_{m}": a for i, f in enumerate(fields) for m, a in _measures(F.col(f"v{i}"), decimals).items()}
    values = df.select(*[_number(f).alias(f"v{i}") for i, f in enumerate(fields)], (F.spark_partition_id() % GROUPS).alias("part"))
    parts = values.groupBy("part").agg(F.count(F.lit(1)).alias("rows_sum"), *[a.alias(m) for m, a in measured.items()])
    wide = parts.agg(*[_merged(m, F.col(m)).alias(m) for m in ("rows_sum", *measured)])

    def entry(i: int, f: T.StructField) -> Column:
        s = {m: F.col(f"{i}_{m}") for m in _measures(F.lit(0.0), decimals)}
        quartile = [F.when(s["known_sum"] > 0, F.kll_sketch_get_quantile_double(s["sketch_kll"], F.lit(q))) for q in QUARTILES]
        rows = F.coalesce("rows_sum", F.lit(0))
        return F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(kind_of(f)).alias("kind"),
            rows.alias("row_count"),
            (rows - F.coalesce(s["known_sum"], F.lit(0))).alias("nulls"),
            s["least_min"].alias("min"),
            quartile[0].alias("q1"),
            quartile[1].alias("median"),
            _mean(s, decimals).alias("mean"),
            quartile[2].alias("q3"),
            s["most_max"].alias("max"),
        )

    if not fields:
        return df.sparkSession.createDataFrame([], "column_name string, kind string, row_count long, nulls long, min double, q1 double, median double, mean double, q3 double, max double")
    return wide.select(F.explode(F.array(*[entry(i, f) for i, f in enumerate(fields)])).alias("e")).select("e.*")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every distinct value of every column with its rows: column_name, value (NULL too), n."""
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(entries).alias("e")).groupBy("e.column_name", "e.value").agg(F.count(F.lit(1)).alias("n"))


def text_summary(df: DataFrame) -> DataFrame:
    """One row per other column: rows, nulls, distinct values, and the most frequent one, of equals the first."""
    columns = [f.name for f in df.schema.fields if kind_of(f) == TEXT]
    kinds = "column_name string, kind string, row_count long, nulls long, distinct long, top string, top_count long"
    names = df.sparkSession.createDataFrame([(c, TEXT) for c in columns], "column_name string, kind string")
    if not columns:
        return df.sparkSession.createDataFrame([], kinds)
    first = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value"))).alias("first")
    found = value_counts(df, columns).groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct"),
        first,
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("row_count", "nulls", "distinct")}
    joined = names.join(found, "column_name", "left")
    return joined.select("column_name", "kind", *zero.values(), F.col("first.value").alias("top"), (-F.col("first.n")).alias("top_count"))


def column_summary(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """One row per column of ``df``: column_name, kind, row_count, nulls; for numbers and dates (as days
    since 1970-01-01) min, q1, median, mean, q3, max; for texts distinct, top, top_count.

    All but the quartiles is exact. A quartile is a value of the column whose rank is off by
    ``RANK_ERROR`` of the rows; up to ``SKETCH`` rows of a column it is exact. NaN is missing. Infinite
    values count as extremes and make the mean infinite, or missing where both signs occur.
    """
    return number_summary(df, decimals).unionByName(text_summary(df), allowMissingColumns=True)


def rank_errors(df: DataFrame, summary: DataFrame) -> DataFrame:
    """How far each quartile's rank is off, as a share of the rows, counted exactly: column_name, quantile, known, rank_error.

    The quartiles, three for each column, are all that is fetched from ``summary``.
    """
    fields = {f.name: f for f in df.schema.fields if kind_of(f) != TEXT}
    found = [(r["column_name"], q, r[c]) for r in summary.where(F.col("kind") != TEXT).collect() for q, c in zip(QUARTILES, ("q1", "median", "q3"))]
    counts = []
    for i, (name, _, value) in enumerate(found):
        c = _number(fields[name])
        below, upto = (F.count_if(c < value), F.count_if(c <= value)) if value is not None else (F.lit(0), F.lit(0))
        counts += [F.count(c).alias(f"n{i}"), below.alias(f"below{i}"), upto.alias(f"upto{i}")]
    wide = df.agg(*counts)
    entries = []
    for i, (name, q, _) in enumerate(found):
        wanted = F.col(f"n{i}") * q
        off = F.greatest(F.col(f"below{i}") - wanted, wanted - F.col(f"upto{i}"), F.lit(0.0))
        share = F.when(F.col(f"n{i}") > 0, off / F.col(f"n{i}")).otherwise(0.0)
        entries.append(F.struct(F.lit(name).alias("column_name"), F.lit(q).alias("quantile"), F.col(f"n{i}").alias("known"), share.alias("rank_error")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
