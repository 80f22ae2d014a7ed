"""Salary statistics, their fallback and both imputations."""

import math

import pytest

from tenurelens.operators import salary
from tenurelens.sources.schema import SALARY_KEYS, SALARY_STATS
from tenurelens.sources.workspace import settle_lookup
from tests.payroll_rows import payroll
from pyspark.sql import functions as F


def checks(spark, *changes):
    return payroll(spark, *changes).withColumn("FISCAL_YEAR", F.lit(2018))


def test_summary(spark):
    df = checks(
        spark,
        {"BIWEEKLY_RATE": 100.0, "HW_TYPE_PAY": 900.0, "OT_TYPE_PAY": 100.0},
        {"BIWEEKLY_RATE": 200.0, "HW_TYPE_PAY": 900.0, "OT_TYPE_PAY": 100.0, "HW_TYPE_HOURS": None},
        {"BIWEEKLY_RATE": 999.0, "JOB_STATUS": "Separated"},
        {"BIWEEKLY_RATE": 999.0, "CHECK_TYPE": "Adjustment"},
    )
    row = salary.summary(df).first()
    assert row["RATE_PP"] == 150.0 and row["HW_HOURS_PP"] is None and row["OT_HOURS_PP"] == 4.0
    assert row["OT_TYPE_PAY_PERSENT"] == pytest.approx(0.1)
    assert row["RATE_PP_ESTIMATE"] == pytest.approx(150 + 150 * 200 / 1800)


@pytest.mark.parametrize(
    "worked, overtime, share, estimate", [(0.0, 0.0, None, None), (0.0, 5.0, 1.0, math.inf), (5.0, 0.0, 0.0, 2000.0)]
)
def test_pay_of_zero(spark, worked, overtime, share, estimate):
    row = salary.summary(checks(spark, {"HW_TYPE_PAY": worked, "OT_TYPE_PAY": overtime})).first()
    assert (row["OT_TYPE_PAY_PERSENT"], row["RATE_PP_ESTIMATE"]) == (share, estimate)


def test_attach_matches_missing_keys(spark):
    stats = ", ".join(f"{c} double" for c in SALARY_STATS)
    panel = spark.createDataFrame([(1, None, "CLERK", None)], "EMPLOYEE_ID long, FISCAL_YEAR int, JOB_CLASS_TITLE string, SALARY_STEP int")
    table = spark.createDataFrame([(1, None, "CLERK", None, 1.0, 2.0, 3.0, 4.0, 5.0)], f"EMPLOYEE_ID long, FISCAL_YEAR int, JOB_CLASS_TITLE string, SALARY_STEP int, {stats}")
    assert salary.attach(panel, table).select(*SALARY_STATS).first() == (1.0, 2.0, 3.0, 4.0, 5.0)
    assert panel.columns == SALARY_KEYS


def test_fallback_is_the_mean_of_group_means(spark):
    # employee 1 has three checks and employee 2 one; both weigh the same
    df = checks(
        spark,
        *[{"BIWEEKLY_RATE": 100.0, "HW_TYPE_PAY": 10.0, "OT_TYPE_PAY": 0.0}] * 3,
        {"EMPLOYEE_ID": 2, "BIWEEKLY_RATE": 300.0, "HW_TYPE_PAY": 10.0, "OT_TYPE_PAY": 30.0},
    )
    row = salary.fallback(salary.summary(df)).first()
    assert row["RATE_PP2"] == 200.0
    # ratio of the means 15 / (15 + 20), not the mean of 0 and 0.75
    assert row["OT_TYPE_PAY_PERSENT2"] == pytest.approx(15 / 35)
    assert row["RATE_PP_ESTIMATE2"] == pytest.approx(200 + 200 * 15 / 20)


FRAME = "JOB_CLASS_TITLE string, SALARY_STEP int, " + ", ".join(f"{c} double" for c in SALARY_STATS)
MEANS = "JOB_CLASS_TITLE string, SALARY_STEP int, " + ", ".join(f"{c}2 double" for c in SALARY_STATS)


@pytest.fixture
def filled(spark):
    means = settle_lookup(spark.createDataFrame([("T", 1, 10.0, 20.0, 30.0, 0.4, 50.0)], MEANS), "means")
    frame = spark.createDataFrame(
        [
            ("T", 1, None, 2.0, None, None, None),
            ("T", 1, 1.0, 2.0, 3.0, 0.5, math.inf),
            ("T", 2, 1.0, 2.0, 3.0, None, 5.0),
            ("T", 2, None, 2.0, 3.0, 0.5, 5.0),
        ],
        FRAME,
    )
    return salary.attach_fallback(frame, means)


def test_train_imputation_fills_each_column_alone(filled, rows):
    assert rows(salary.impute_train(filled).select(*SALARY_STATS)) == sorted(
        [(10.0, 2.0, 30.0, 0.4, 50.0), (1.0, 2.0, 3.0, 0.5, math.inf)], key=repr
    )


def test_score_imputation_fills_two_and_grows_one(filled, rows):
    assert rows(salary.impute_score(filled).select(*SALARY_STATS)) == sorted(
        [(None, 2.0, None, 0.4, 51.0), (1.0, 2.0, 3.0, 0.5, math.inf), (None, 2.0, 3.0, 0.5, 5.0)], key=repr
    )
