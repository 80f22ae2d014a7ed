"""Aggregates, division and membership with missing values."""

import math

import pytest
from pyspark.sql import functions as F

from tenurelens.functions.nullsafe import exact_sum, ieee_div, in_list, strict_avg, strict_max, strict_sum, three_valued


@pytest.fixture
def groups(spark):
    data = [("one", 1.0), ("one", None), ("all", None), ("all", None), ("none", 1.0), ("none", 4.0)]
    return spark.createDataFrame(data, "g string, x double").groupBy("g")


@pytest.mark.parametrize(
    "agg, expected", [(strict_avg, 2.5), (strict_sum, 5.0), (strict_max, 4.0)]
)
def test_a_missing_value_makes_the_statistic_missing(groups, agg, expected):
    assert dict(groups.agg(agg("x")).collect()) == {"one": None, "all": None, "none": expected}


def test_sums_do_not_depend_on_the_order_of_addition(spark):
    # 200 * (0.6 + 1000000.4 + 12345.67)
    values = [0.1, 0.2, 0.3, 1e6 + 0.4, 12345.67] * 200
    for order in (values, values[::-1], sorted(values)):
        df = spark.createDataFrame([(v,) for v in order], "x double").repartition(7)
        assert df.agg(strict_sum("x")).first()[0] == 202469334.0


def test_large_and_negative_sums_are_exact(spark):
    df = spark.range(1_000_000).selectExpr("case when id % 2 = 0 then 98765432109.8765 else -0.0001 end as x")
    assert df.agg(exact_sum("x")).first()[0] == (500_000 * 987654321098765 - 500_000) / 10_000
    # far beyond what one bigint of ten-thousandths could hold
    big = spark.range(1000).selectExpr("1e15 as x")
    assert big.agg(exact_sum("x")).first()[0] == pytest.approx(1e18, rel=1e-15)


@pytest.mark.parametrize(
    "num, den, expected",
    [
        (0.0, 0.0, None),
        (1.0, 0.0, math.inf),
        (-1.0, 0.0, -math.inf),
        (None, 0.0, None),
        (1.0, None, None),
        (3.0, 2.0, 1.5),
        (0.0, 2.0, 0.0),
    ],
)
def test_division(spark, num, den, expected):
    df = spark.createDataFrame([(num, den)], "a double, b double")
    assert df.select(ieee_div("a", "b")).first()[0] == expected


def test_membership_is_never_missing(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert [r[0] for r in df.select(in_list("x", [1, 3])).collect()] == [True, False, False]


def test_flag_of_an_unknown_condition_is_missing(spark):
    df = spark.createDataFrame([(60, 12), (50, 12), (None, 9), (None, 11)], "age int, sy int")
    flag = three_valued((F.col("age") >= 55) & (F.col("sy") >= 10))
    assert [r[0] for r in df.select(flag).collect()] == [1, 0, 0, None]


def test_sums_keep_small_values_and_nan_is_missing(spark):
    from tenurelens.functions.nullsafe import strict_avg, strict_sum

    small = spark.createDataFrame([(0.00004,)] * 1000 + [(10.12346,)], "v double")
    total, mean = small.agg(strict_sum("v"), strict_avg("v")).first()
    assert abs(total - 10.16346) < 1e-9 and abs(mean - 10.16346 / 1001) < 1e-12
    assert spark.createDataFrame([(10.12346,)], "v double").agg(strict_avg("v")).first()[0] == 10.12346
    odd = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    assert tuple(odd.agg(strict_sum("v"), strict_avg("v")).first()) == (None, None)
