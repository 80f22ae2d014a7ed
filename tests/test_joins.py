"""Missing keys match; broadcast and shuffled lookups agree."""

import pytest

from tenurelens.operators import joins
from tenurelens.operators.joins import lookup_join, null_safe_join
from tenurelens.sources.workspace import Lookup, settle_lookup

LEFT = [("a", 1), (None, 2), ("z", 3), ("a", 4)]
RIGHT = [("a", 10), (None, 20), ("b", 30)]
MATCHED = [("a", 1, 10), ("a", 4, 10), ("z", 3, None), (None, 2, 20)]


@pytest.fixture
def sides(spark):
    return spark.createDataFrame(LEFT, "k string, l int"), spark.createDataFrame(RIGHT, "k string, r int")


def test_missing_keys_match(sides, rows):
    assert rows(null_safe_join(*sides, ["k"])) == sorted(MATCHED, key=repr)


def test_different_names_keep_the_left_key(sides, rows):
    left, right = sides
    joined = null_safe_join(left, right.withColumnRenamed("k", "other"), [("k", "other")])
    assert joined.columns == ["k", "l", "r"]
    assert rows(joined) == sorted(MATCHED, key=repr)


def test_repeated_right_rows_multiply(spark, rows):
    left = spark.createDataFrame([(1, "x")], "EMPLOYEE_ID long, v string")
    right = spark.createDataFrame([(1, 7), (1, 8)], "EMPLOYEE_ID long, w int")
    assert rows(null_safe_join(left, right, ["EMPLOYEE_ID"])) == [(1, "x", 7), (1, "x", 8)]


def test_the_measured_size_decides(sides, rows, monkeypatch):
    left, right = sides
    lookup = settle_lookup(right, "right")
    assert lookup.rows == 3
    small = lookup_join(left, lookup, ["k"])
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
    large = lookup_join(left, lookup, ["k"])
    assert "strategy=broadcast" not in large._jdf.queryExecution().analyzed().toString()
    assert rows(small) == rows(large) == sorted(MATCHED, key=repr)


def test_wide_rows_are_not_hinted(sides, spark):
    left, right = sides
    plan = lookup_join(left, Lookup(right, 3, 10**9), ["k"])._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in plan
