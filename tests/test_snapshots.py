"""Counted, refused and allowed multiplication of the last-period joins."""

from dataclasses import replace

import pytest

from checks import queries as q
from tenurelens.config import PolicyConfig
from tenurelens.operators import employee_year as ey, snapshots
from tenurelens.plans import frames
from tenurelens.plans.history import build_history
from tenurelens.sources import schema
from tenurelens.sources.workspace import settle, settle_lookup, settle_measured
from tests.conftest import SMALL
from tests.payroll_rows import calendar, payroll

YEARS = {1: 2017, 2: 2017, 3: 2018}
STRICT = replace(PolicyConfig(), snapshot_mode="strict")
TWO = [
    {"PAYROLL_SEQUENCE": 1, "MOU": 1},
    {"PAYROLL_SEQUENCE": 2},
    {"PAYROLL_SEQUENCE": 2, "JOB_CLASS_TITLE": "CHIEF"},
    {"PAYROLL_SEQUENCE": 2, "MOU": None},
    {"PAYROLL_SEQUENCE": 2, "BIWEEKLY_RATE": 2100.0},
    {"PAYROLL_SEQUENCE": 3},
]


def steps(spark, *extra):
    return spark.createDataFrame([("77", "CHIEF", "0", 8), *extra], schema.JOB_STEPS)


def panel(spark, cfg, *changes):
    checks = ey.with_fiscal_year(payroll(spark, *changes), settle_lookup(calendar(spark, YEARS), "cal"))
    return checks, ey.snapshot_panel(checks, settle(ey.spells(checks), "spells"), cfg)


def test_the_report_counts_what_the_joins_make(spark):
    changes = [*TWO, {"EMPLOYEE_ID": 2}, {"EMPLOYEE_ID": 3, "DATE_OF_BIRTH": None}, {"EMPLOYEE_ID": 3}]
    checks, found = panel(spark, PolicyConfig(), *changes)
    last = ey.last_period(checks)
    rows = last
    for columns in (schema.SNAPSHOT, ["MOU"], ["JOB_CLASS"]):
        rows = ey.attach_last_period(rows, checks, columns)
    rates = ey.attach_last_period(rows.select("EMPLOYEE_ID", "MAX_PP"), checks, ["BIWEEKLY_RATE"])
    joined = rows.select("EMPLOYEE_ID", "MAX_PP").join(rates, ["EMPLOYEE_ID", "MAX_PP"])
    report = found.report
    assert (report.employee_years, report.snapshot_rows, report.pension_rows) == (last.count(), rows.count(), joined.count())
    # employee 1 in 2017 with two titles, two units and two rates; employee 3 with two birth dates
    assert report.ambiguous == 2 and report.pension_rows == 32 + 1 + 1 + 4 and report.factor == 38 / 5


def test_strict_mode_names_number_and_keys(spark):
    with pytest.raises(snapshots.AmbiguousSnapshots, match=r"1 of 3 .* 34 rows.* employee 1 in period 2 \(32 rows\)"):
        panel(spark, STRICT, *TWO, {"EMPLOYEE_ID": 2})


def test_literal_mode_may_have_a_limit(spark):
    _, found = panel(spark, replace(PolicyConfig(), fan_out_limit=20.0), *TWO)
    assert found.report.factor == 33 / 2 and found.multiple is not None
    with pytest.raises(snapshots.AmbiguousSnapshots, match="16.50 to each"):
        panel(spark, replace(PolicyConfig(), fan_out_limit=16.0), *TWO)
    with pytest.raises(ValueError, match="snapshot_mode"):
        panel(spark, replace(PolicyConfig(), snapshot_mode="lax"), *TWO)


def test_strict_mode_takes_what_is_unique(spark, rows):
    """Also where two birth dates end in different periods: one join, and no table of rates."""
    changes = [{"PAYROLL_SEQUENCE": 1, "DATE_OF_BIRTH": "16-MAR-55", "MOU": 5}, {"PAYROLL_SEQUENCE": 2}, {"PAYROLL_SEQUENCE": 3, "BIWEEKLY_RATE": None}]
    _, literal = panel(spark, PolicyConfig(), *changes)
    checks, strict = panel(spark, STRICT, *changes)
    assert strict.multiple is None and strict.rates is None and strict.report == literal.report
    expected = ey.last_period(checks)
    for columns in (schema.SNAPSHOT, ["MOU"], ["JOB_CLASS"], ["BIWEEKLY_RATE"]):
        expected = ey.attach_last_period(expected, checks, columns)
    assert rows(strict.single.select(*expected.columns)) == rows(expected) and strict.report.employee_years == 3


def test_strict_mode_refuses_two_ceilings(spark):
    table = steps(spark, ("1358", "CLERK", "0", 5), ("1358", "CLERK", "0", 6))
    with pytest.raises(snapshots.AmbiguousSnapshots, match=r"1 jobs .*1358, 'CLERK', '0'"):
        build_history(payroll(spark, {}), calendar(spark, YEARS), table, STRICT)
    assert frames.train_base(build_history(payroll(spark, {}), calendar(spark, YEARS), table)).count() == 4


def test_an_empty_panel_multiplies_nothing(spark):
    _, found = panel(spark, STRICT, {"CHECK_TYPE": "Adjustment"})
    assert found.report == snapshots.SnapshotReport(0, 0, 0, 0) and found.report.factor == 1.0


def test_the_twin_is_refused_in_strict_mode(spark):
    refused = q.fanned(q.snapshot_refused)(spark, SMALL).count()
    with pytest.raises(snapshots.AmbiguousSnapshots, match=f"^{refused} of "):
        q.fanned(q.train_frame_strict)(spark, SMALL)


def test_metrics_are_those_of_the_written_rows(spark):
    from pyspark.sql import functions as F

    table, seen = settle_measured(spark.range(10), "ten", n=F.count(F.lit(1)), total=F.sum("id"))
    assert seen == {"n": 10, "total": 45} and table.count() == 10
    assert settle_measured(spark.range(0), "none", total=F.sum("id"))[1] == {"total": 0}
