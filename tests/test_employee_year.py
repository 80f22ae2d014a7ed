"""Panel, snapshot joins and labels on hand-written checks."""

import pytest

from tenurelens.operators import employee_year as ey, salary
from tenurelens.sources.schema import SNAPSHOT
from tenurelens.sources.workspace import settle, settle_lookup
from tests.payroll_rows import calendar, payroll

YEARS = {1: 2017, 2: 2017, 3: 2017, 4: 2018, 5: 2018, 6: 2018}


def with_year(spark, *changes):
    return ey.with_fiscal_year(payroll(spark, *changes), settle_lookup(calendar(spark, YEARS), "cal"))


def by_joins(checks):
    """The panel as last period plus the four attribute joins."""
    rows = ey.last_period(checks)
    for columns in (SNAPSHOT, ["MOU"], ["JOB_CLASS"], ["BIWEEKLY_RATE"]):
        rows = ey.attach_last_period(rows, checks, columns)
    return rows


def by_pass(checks):
    """The same from one scan; multiple rows meet their rates by a join."""
    found = ey.snapshot_panel(checks, settle(ey.spells(checks), "spells"))
    rows = found.single
    if found.multiple is not None:
        rows = rows.unionByName(ey.null_safe_join(found.multiple, found.rates, ey.LAST_PERIOD))
    return rows, found


CASES = {
    "plain": [{"PAYROLL_SEQUENCE": p} for p in (1, 2, 4)],
    "attributes change between periods": [
        {"PAYROLL_SEQUENCE": 1},
        {"PAYROLL_SEQUENCE": 2, "JOB_CLASS_TITLE": "CHIEF", "MOU": None, "BIWEEKLY_RATE": 3000.0},
        {"PAYROLL_SEQUENCE": 3},
    ],
    "two attribute rows in the last period": [
        {"PAYROLL_SEQUENCE": 1, "SALARY_STEP": 1},
        {"PAYROLL_SEQUENCE": 2},
        {"PAYROLL_SEQUENCE": 2, "JOB_CLASS_TITLE": "CHIEF"},
        {"PAYROLL_SEQUENCE": 2, "MOU": 3},
        {"PAYROLL_SEQUENCE": 2, "BIWEEKLY_RATE": 2100.0},
    ],
    "an adjustment in the last period differs": [
        {"PAYROLL_SEQUENCE": 2},
        {"PAYROLL_SEQUENCE": 2, "CHECK_TYPE": "Adjustment", "JOB_STATUS": "Separated"},
    ],
    "an adjustment in the last period agrees": [
        {"PAYROLL_SEQUENCE": 2},
        {"PAYROLL_SEQUENCE": 2, "CHECK_TYPE": "Adjustment", "HW_TYPE_PAY": 1.0},
    ],
    "an adjustment in another period differs": [
        {"PAYROLL_SEQUENCE": 1, "CHECK_TYPE": "Adjustment", "JOB_CLASS_TITLE": "CHIEF"},
        {"PAYROLL_SEQUENCE": 2},
        {"PAYROLL_SEQUENCE": 3, "CHECK_TYPE": None, "JOB_CLASS_TITLE": "CHIEF"},
    ],
    "only adjustments in a year": [
        {"PAYROLL_SEQUENCE": 2},
        {"PAYROLL_SEQUENCE": 5, "CHECK_TYPE": "Adjustment"},
    ],
    "two birth dates in a year": [
        {"PAYROLL_SEQUENCE": 1, "DATE_OF_BIRTH": "16-MAR-55", "MOU": 5},
        {"PAYROLL_SEQUENCE": 1, "CHECK_TYPE": "Adjustment", "MOU": 7},
        {"PAYROLL_SEQUENCE": 3},
        {"PAYROLL_SEQUENCE": 3, "BIWEEKLY_RATE": 1.0},
        {"PAYROLL_SEQUENCE": 4},
    ],
    "missing dates and attributes": [
        {"PAYROLL_SEQUENCE": 2, "DATE_OF_BIRTH": None, "MOU": None, "JOB_CLASS": None},
        {"PAYROLL_SEQUENCE": 5, "ORIGINAL_HIRE_DATE": None, "BIWEEKLY_RATE": None},
    ],
    "a period without a fiscal year": [{"PAYROLL_SEQUENCE": 9}, {"PAYROLL_SEQUENCE": 2}],
}


@pytest.mark.parametrize("name", CASES)
def test_one_scan_equals_the_joins(spark, rows, name):
    others = [{**c, "EMPLOYEE_ID": 2, "JOB_CLASS_TITLE": "OTHER"} for c in CASES["plain"]]
    checks = with_year(spark, *CASES[name], *others)
    expected = by_joins(checks)
    found, _ = by_pass(checks)
    assert rows(found.select(*expected.columns)) == rows(expected)


def test_everything_at_once_equals_the_joins(spark, rows):
    changes = [{**c, "EMPLOYEE_ID": i} for i, case in enumerate(CASES.values()) for c in case]
    checks = with_year(spark, *changes)
    expected = by_joins(checks)
    found, parts = by_pass(checks)
    assert parts.multiple is not None
    assert rows(found.select(*expected.columns)) == rows(expected)


def test_clean_history_needs_no_joins(spark):
    _, parts = by_pass(with_year(spark, *CASES["plain"]))
    assert parts.multiple is None and parts.rates is None


def test_several_attribute_rows_multiply(spark):
    found, _ = by_pass(with_year(spark, *CASES["two attribute rows in the last period"]))
    # two titles, two units, one job class, two rates
    assert found.count() == 8


def test_last_period_counts_regular_checks_only(spark, rows):
    checks = with_year(spark, {"PAYROLL_SEQUENCE": 1}, {"PAYROLL_SEQUENCE": 3, "CHECK_TYPE": "Adjustment"})
    assert [r["MAX_PP"] for r in ey.last_period(checks).collect()] == [1]


def test_salary_statistics_of_spells_equal_those_of_checks(spark, rows):
    changes = [{**c, "EMPLOYEE_ID": i} for i, case in enumerate(CASES.values()) for c in case]
    changes += [{"EMPLOYEE_ID": 50, "PAYROLL_SEQUENCE": p, "HW_TYPE_HOURS": h} for p, h in ((1, 70.1), (2, 80.2), (3, None), (4, 3.3))]
    changes += [{"EMPLOYEE_ID": 51, "PAYROLL_SEQUENCE": p, "BIWEEKLY_RATE": r, "OT_TYPE_PAY": 0.1} for p, r in ((1, 1.1), (1, 1.1), (2, 2.2), (4, None))]
    checks = with_year(spark, *changes)
    from_checks = salary.summary(checks)
    from_spells = salary.summary_of_spells(ey.spells(checks))
    assert from_spells.columns == from_checks.columns
    assert rows(from_spells) == rows(from_checks)


def test_ages_and_dropped_hire_dates(spark):
    checks = with_year(spark, {"PAYROLL_SEQUENCE": 4}, {"EMPLOYEE_ID": 2, "PAYROLL_SEQUENCE": 4, "ORIGINAL_HIRE_DATE": None},
                       {"EMPLOYEE_ID": 3, "PAYROLL_SEQUENCE": 4, "DATE_OF_BIRTH": None})
    found = {r["EMPLOYEE_ID"]: r for r in ey.with_ages(ey.last_period(checks)).collect()}
    assert set(found) == {1, 3}
    assert (found[1]["age"], found[1]["service_year"]) == (64, 34)
    assert found[3]["age"] is None


@pytest.mark.parametrize(
    "status, reason, expected",
    [
        ("Active", None, 0),
        ("Active", "Retired/Pensioned", 0),
        ("Separated", "Retired/Pensioned", 1),
        ("Separated", "Resigned", 2),
        ("Separated", None, None),
        (None, "Retired/Pensioned", None),
    ],
)
def test_label(spark, status, reason, expected):
    df = spark.createDataFrame([(status, reason)], "JOB_STATUS string, SEPARATION_REASON string")
    assert df.select(ey.retire_label()).first()[0] == expected
    assert ey.with_label(df).count() == (expected in (0, 1))


def test_supervisors(spark):
    df = spark.createDataFrame([(12,), (63,), (1,), (None,)], "MOU int")
    assert [r[0] for r in df.select(ey.supervisor_flag()).collect()] == [1, 1, 0, 0]


def test_the_panel_needs_no_spells(spark, rows):
    changes = [{**c, "EMPLOYEE_ID": i} for i, case in enumerate(CASES.values()) for c in case]
    checks = with_year(spark, *changes)
    direct, other = ey.snapshot_panel(checks), ey.snapshot_panel(checks, settle(ey.spells(checks), "spells"))
    assert direct.report == other.report
    assert rows(direct.single) == rows(other.single) and rows(direct.multiple) == rows(other.multiple)
    assert rows(direct.rates) == rows(other.rates)


def test_a_large_panel_neither_sorts_nor_shuffles_checks_twice(spark, rows):
    """Beyond the size of a broadcast the checks move once, by employee and period, and are told apart there."""
    checks = settle(with_year(spark, *CASES["two attribute rows in the last period"]), "checks")
    panel = ey._keyed(settle(ey.last_period(checks), "last"), "MAX_PP")
    large = ey.states_at_last(checks, panel, ey.BROADCAST_ROWS + 1)
    text = large._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and "Sort" not in text and "ShuffledHashJoin" in text
    assert rows(large) == rows(ey.states_at_last(checks, panel, 1)) and large.count() == 4
