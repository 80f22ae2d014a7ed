"""Column summaries against plain counting."""

import math
import random
from datetime import date

from pyspark.sql import functions as F

from tenurelens.operators import profile

NAN, INF = float("nan"), float("inf")


def summary(df):
    return {r["column_name"]: r for r in profile.column_summary(df).collect()}


def test_every_column_has_a_row(spark):
    rows = [(1, 1.5, "a", date(2018, 7, 1), True), (2, NAN, "b", None, None), (None, -2.5, "", date(1970, 1, 1), True), (4, 1.0, None, date(2018, 7, 2), False)]
    found = summary(spark.createDataFrame(rows, "n int, x double, `a b` string, d date, flag boolean"))
    assert {c: (r["kind"], r["row_count"], r["nulls"]) for c, r in found.items()} == {
        "n": ("number", 4, 1), "x": ("number", 4, 1), "a b": ("text", 4, 1), "d": ("date", 4, 1), "flag": ("text", 4, 1),
    }
    assert (found["n"]["min"], found["n"]["median"], found["n"]["mean"], found["n"]["max"]) == (1, 2, 7 / 3, 4)
    assert (found["x"]["min"], found["x"]["mean"], found["x"]["max"]) == (-2.5, 0.0, 1.5)
    assert (found["d"]["min"], found["d"]["max"]) == (0, (date(2018, 7, 2) - date(1970, 1, 1)).days)
    # equal counts: the first value
    assert (found["a b"]["distinct"], found["a b"]["top"], found["a b"]["top_count"]) == (3, "", 1)
    assert (found["flag"]["distinct"], found["flag"]["top"], found["flag"]["top_count"]) == (2, "true", 2)
    assert found["a b"]["mean"] is None and found["n"]["top"] is None


def test_infinite_values_and_empty_columns(spark):
    rows = [(INF, INF, None, None), (1.0, -INF, None, None), (None, 2.0, None, None)]
    found = summary(spark.createDataFrame(rows, "a double, b double, c double, d string"))
    assert (found["a"]["min"], found["a"]["mean"], found["a"]["max"]) == (1.0, INF, INF)
    assert (found["b"]["min"], found["b"]["mean"], found["b"]["max"]) == (-INF, None, INF)
    for c in "cd":
        assert found[c]["nulls"] == found[c]["row_count"] == 3
        assert all(found[c][x] is None for x in ("min", "q1", "mean", "max", "top", "top_count"))
    none = summary(spark.createDataFrame([], "a double, t string"))
    assert {(r["row_count"], r["nulls"], r["min"], r["top"]) for r in none.values()} == {(0, 0, None, None)}


def test_small_columns_have_exact_quartiles(spark):
    values = random.Random(1).sample(range(100_000), 4001)
    found = summary(spark.createDataFrame([(v,) for v in values], "n int").repartition(9))["n"]
    values.sort()
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = values.index(found[name])
        assert abs(at - q * len(values)) <= 1


def test_ranks_of_quartiles_are_as_promised(spark):
    """Skewed, tied, sorted and nearly constant columns over many partitions."""
    df = spark.range(0, 400_000, 1, 37).select(
        F.col("id"),
        F.exp(F.rand(3) * 30).alias("skewed"),
        (F.col("id") % 7).alias("tied"),
        F.when(F.col("id") % 1000 == 0, F.col("id")).otherwise(5).alias("constant"),
        F.when(F.col("id") % 2 == 0, F.col("id") * 0.5).alias("half"),
    )
    errors = profile.rank_errors(df, profile.column_summary(df)).collect()
    assert len(errors) == 15 and {r["known"] for r in errors} == {400_000, 200_000}
    assert max(r["rank_error"] for r in errors) <= 3 * profile.RANK_ERROR


def test_wrong_quartiles_are_noticed(spark):
    df = spark.range(1000).toDF("n")
    wrong = profile.column_summary(df).withColumn("median", F.col("median") + 100)
    errors = {r["quantile"]: r["rank_error"] for r in profile.rank_errors(df, wrong).collect()}
    assert math.isclose(errors[0.5], 0.1, abs_tol=0.002) and errors[0.25] <= 0.001


def test_no_task_merges_all_sketches_and_no_column_is_gathered(spark):
    plan = profile.number_summary(spark.range(0, 10, 1, 3).toDF("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "hashpartitioning(part" in plan and "collect" not in plan
