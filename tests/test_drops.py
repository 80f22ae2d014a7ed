"""Rows dropped by each rule."""

from pyspark.sql import functions as F

from checks import queries as q
from tenurelens.plans import drops, frames
from tenurelens.plans.history import build_history
from tenurelens.sources import schema
from tests.conftest import SMALL
from tests.payroll_rows import calendar, payroll


def test_a_row_falls_to_the_first_rule_it_meets(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (None, None), (3, 7)], "a int, b int")
    found = drops.counted(rows, "f", [("no a", F.col("a").isNull()), ("no b", F.col("b").isNull()), ("large", F.col("b") > 6)]).collect()
    assert [tuple(r) for r in found] == [("f", 1, "no a", 4, 1), ("f", 2, "no b", 3, 1), ("f", 3, "large", 2, 1)]
    assert [tuple(r)[3:] for r in drops.counted(rows.limit(0), "f", [("no a", F.col("a").isNull())]).collect()] == [(0, 0)]


def test_every_rule_of_the_panel(spark):
    checks = payroll(
        spark,
        {},
        {"EMPLOYEE_ID": 2, "ORIGINAL_HIRE_DATE": None},
        {"EMPLOYEE_ID": 3, "ORIGINAL_HIRE_DATE": "soon"},
        {"EMPLOYEE_ID": 4, "JOB_STATUS": "Separated", "SEPARATION_REASON": "Resigned"},
        {"EMPLOYEE_ID": 5, "JOB_STATUS": None},
        {"EMPLOYEE_ID": 6, "JOB_STATUS": "Separated", "SEPARATION_REASON": "Retired/Pensioned"},
    )
    past = build_history(checks, calendar(spark, {1: 2018}), spark.createDataFrame([], schema.JOB_STEPS))
    fitted = frames.train_frame(past)
    found = {(r["frame"], r["rule"]): (r["rows_in"], r["dropped"]) for r in drops.report(past, fitted, frames.scored(past, fitted.means)).collect()}
    assert found["panel", "no readable hire date"] == (6, 2)
    assert found["panel", "unknown status or reason"] == (4, 1)
    assert found["panel", "left for another reason"] == (3, 1)
    # who has left has no salary statistics of the year, but those of title and step
    assert found["train", "no rate"] == (2, 0) and past.panel.count() == 2


def test_what_is_kept_is_what_was_not_dropped(spark):
    past = q.history(spark, SMALL)
    fitted = frames.train_frame(past, q.CFG)
    scored = frames.scored(past, fitted.means, q.CFG)
    found = drops.report(past, fitted, scored, q.CFG).collect()
    left = {r["frame"]: r["rows_in"] - r["dropped"] for r in sorted(found, key=lambda r: r["step"])}
    assert left == {"panel": past.panel.count(), "train": fitted.frame.count(), "score": scored.frame.count()}
    expected = frames.score_frame(past, fitted.means, q.CFG)
    assert sorted(map(repr, scored.frame.select(*expected.columns).collect())) == sorted(map(repr, expected.collect()))
