"""Whole frames: repeated step rows, refused calendars, the job on files."""

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import queries as q
from tenurelens import __main__ as job
from tenurelens.config import PolicyConfig
from tenurelens.operators import eligibility as el, employee_year as ey, encode, forest, steps
from tenurelens.plans import frames, modelling
from tenurelens.plans.history import build_history, panel_rows
from checks import trade_payroll as trade
from tenurelens.sources import io, schema
from tenurelens.sources.workspace import run_folder, settle, settle_lookup
from tests.conftest import SMALL
from tests.payroll_rows import calendar, payroll

YEARS = {1: 2017, 2: 2018}


def step_rows(spark, *extra):
    table = [("1358", "CLERK", "0", 5), ("77", "CHIEF", "0", 8), *extra]
    return spark.createDataFrame(table, schema.JOB_STEPS)


def test_two_ceilings_multiply_the_pension_join(spark, rows):
    """Employee 1 meets two ceilings; the pension join then pairs both rows."""
    checks = payroll(
        spark,
        *[{"PAYROLL_SEQUENCE": p} for p in (1, 2)],
        *[{"EMPLOYEE_ID": 2, "PAYROLL_SEQUENCE": p, "JOB_CLASS_TITLE": "CHIEF", "JOB_CLASS": 77} for p in (1, 2)],
        # two rates in the last period of employee 3
        {"EMPLOYEE_ID": 3, "PAYROLL_SEQUENCE": 2, "JOB_CLASS_TITLE": "CHIEF", "JOB_CLASS": 77},
        {"EMPLOYEE_ID": 3, "PAYROLL_SEQUENCE": 2, "JOB_CLASS_TITLE": "CHIEF", "JOB_CLASS": 77, "BIWEEKLY_RATE": 1.0},
        # two titles, one of them with two ceilings, in the last period of employee 4
        {"EMPLOYEE_ID": 4, "PAYROLL_SEQUENCE": 2},
        {"EMPLOYEE_ID": 4, "PAYROLL_SEQUENCE": 2, "JOB_CLASS_TITLE": "CHIEF"},
    )
    table = step_rows(spark, ("1358", "CLERK", "0", 6))
    past = build_history(checks, calendar(spark, YEARS), table)
    found = frames.train_base(past).groupBy("EMPLOYEE_ID", "FISCAL_YEAR").count()
    assert rows(found) == [(1, 2017, 4), (1, 2018, 4), (2, 2017, 1), (2, 2018, 1), (3, 2018, 2), (4, 2018, 9)]
    score = frames.score_base(past).groupBy("EMPLOYEE_ID").count()
    assert rows(score) == [(1, 4), (2, 1), (3, 2), (4, 9)]

    literal = ey.with_fiscal_year(checks, settle_lookup(calendar(spark, YEARS), "cal"))
    panel = ey.last_period(literal)
    for columns in (schema.SNAPSHOT, ["MOU"], ["JOB_CLASS"]):
        panel = ey.attach_last_period(panel, literal, columns)
    panel = ey.with_label(ey.with_ages(panel))
    panel = steps.with_steps(panel, settle_lookup(steps.step_table(table), "steps")).filter(el.is_eligible())
    pension = el.pension_table(panel, ey.snapshot(literal, ["BIWEEKLY_RATE"]))
    expected = el.attach_pension(panel, pension)
    columns = ["EMPLOYEE_ID", "FISCAL_YEAR", "JOB_CLASS_TITLE", "HIGHEST_STEP", "retirement_factor", "retirement_pension"]
    assert rows(frames.train_base(past).select(*columns)) == rows(expected.select(*columns))


def test_checks_are_gone_when_the_history_is_written(spark, rows):
    with run_folder(spark) as folder:
        checks = payroll(spark, *[{"PAYROLL_SEQUENCE": p, "BIWEEKLY_RATE": r} for p in (1, 2) for r in (1000.0, 1100.0)])
        past = build_history(checks, calendar(spark, YEARS), step_rows(spark))
        names = {p.name for p in Path(folder.removeprefix("file://")).glob("*/*")}
        assert not names & {"checks", "salaries"}
        assert past.rows.count() == 2 and past.rates.count() == 4 and past.panel.count() == 2


def several_rates(spark):
    """Employee 1 has two rates in each last period, employee 2 two titles and two rates, employee 3 one of both."""
    both = [{"BIWEEKLY_RATE": r} for r in (1000.0, 1100.0)]
    return payroll(
        spark,
        *[{"PAYROLL_SEQUENCE": p, **x} for p in (1, 2) for x in both],
        *[{"EMPLOYEE_ID": 2, "PAYROLL_SEQUENCE": 2, "JOB_CLASS_TITLE": t, **x} for t in ("CLERK", "CHIEF") for x in both],
        {"EMPLOYEE_ID": 3, "PAYROLL_SEQUENCE": 2, "JOB_STATUS": "Separated", "SEPARATION_REASON": "Retired/Pensioned"},
        *[{"EMPLOYEE_ID": 3, "PAYROLL_SEQUENCE": p} for p in (1,)],
    )


def test_rows_are_written_before_the_pension_join_repeats_them(spark, rows):
    with run_folder(spark) as folder:
        written = lambda name: [str(p) for p in Path(folder.removeprefix("file://")).glob(f"*/{name}")]
        past = build_history(several_rates(spark), calendar(spark, YEARS), step_rows(spark))
        fitted = frames.train_frame(past)
        repeated = rows(fitted.rows.groupBy("EMPLOYEE_ID", "FISCAL_YEAR").count())
        assert repeated == [(1, 2017, 2), (1, 2018, 2), (2, 2018, 8), (3, 2017, 1), (3, 2018, 1)]
        assert spark.read.parquet(*written("train_rows")).count() == 6
        assert set(fitted.frame.columns) == set(schema.TRAIN_FRAME.names)


def test_means_weigh_rows_by_how_often_they_are_repeated(spark, rows):
    past = build_history(several_rates(spark), calendar(spark, YEARS), step_rows(spark))
    fitted = frames.train_frame(past)
    literal = encode.TargetMeans.fit(frames.train_base(past))
    assert rows(fitted.means.table) == rows(literal.table)
    assert rows(fitted.frame) == rows(literal.apply(frames.train_base(past)))
    assert rows(frames.train_frame(past, fit_on=F.lit(True)).means.table) == rows(literal.table)
    unseen = literal.apply_unseen(frames.score_base(past))
    assert rows(frames.score_frame(past, fitted.means)) == rows(unseen) == rows(frames.scored(past, fitted.means).frame)
    for frame, names in ((unseen, schema.SCORE_FRAME.names), (fitted.frame, schema.TRAIN_FRAME.names)):
        at = frame.columns.index("retirement_factor")
        assert frame.columns[at : at + 4] == names[names.index("retirement_factor") :][:4] and set(frame.columns) == set(names)


def test_a_calendar_with_a_period_twice_is_refused(spark):
    twice = calendar(spark, YEARS).union(calendar(spark, {1: 2018}))
    with pytest.raises(ValueError, match="more than once"):
        build_history(payroll(spark, {}), twice, step_rows(spark))


@pytest.fixture(scope="module")
def past(spark):
    return q.history(spark, SMALL)


def test_both_frames_keep_the_peer_statistics(past):
    fitted = frames.train_frame(past, q.CFG)
    score = frames.score_frame(past, fitted.means, q.CFG)
    for frame in (fitted.frame, score):
        assert {"eligible_persent", "total_ecount"} <= set(frame.columns)
        assert not [c for c in frame.columns if c.endswith("2")]
    assert set(fitted.frame.columns) - set(score.columns) == {
        "DATE_OF_BIRTH", "ORIGINAL_HIRE_DATE", "MAX_PP", "retire", "JOB_CLASS",
    }


def test_score_frame_is_next_year_without_imputed_rates(past):
    score = frames.score_base(past, q.CFG)
    assert {r[0] for r in score.select("FISCAL_YEAR").distinct().collect()} == {q.CFG.last_fiscal_year + 1}
    assert score.filter("OT_TYPE_PAY_PERSENT is null").isEmpty()
    assert score.filter("age < 55 or service_year < 10").isEmpty()


def test_target_means_may_leave_out_test_rows(past):
    everything = frames.train_frame(past, q.CFG)
    some = frames.train_frame(past, q.CFG, fit_on=forest.split_bucket(q.CFG) < 80)
    assert some.frame.count() == everything.frame.count()
    all_means = dict(everything.means.means("GENDER_persent").collect())
    train_means = dict(some.means.means("GENDER_persent").collect())
    assert set(all_means) == set(train_means) and all_means != train_means


def test_last_year_is_read_alone(past):
    plan = frames.sf.score_population(past.panel, q.CFG)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(FISCAL_YEAR" in plan


def test_tune_runs_its_stages(spark, past):
    rows = modelling.model_rows(frames.train_frame(past, q.CFG).frame, "rows", q.CFG)
    small = forest.ForestParams(trees=2, depth=2, min_split=4, min_leaf=2)
    stages = [forest.Stage(small, {"trees": (2, 3)}), forest.Stage(small, {"features": ("2", "8")})]
    tuned = modelling.tune(rows, (0.5, 0.3), replace(q.CFG, folds=2), stages)
    found = tuned.points.collect()
    assert sorted((r["beta"], r["stage"]) for r in found) == [(b, s) for b in (0.3, 0.5) for s in (1, 1, 2, 2)]
    assert {r["max_features"] for r in found if r["stage"] == 2} == {"2", "8"}
    # stage 2 holds the first forest once more, and both betas share all fits
    assert tuned.fitted == 3 * 2 and tuned.folds.count() == 8 * 2 and tuned.best().count() == 4


def test_job_on_files(spark, tmp_path, rows):
    paths = {n: str(tmp_path / n) for n in ("payroll", "calendar", "steps", "out")}
    io.write_csv(trade.payroll(spark, SMALL), paths["payroll"])
    io.write_csv(trade.fiscal_calendar(spark, SMALL), paths["calendar"])
    paths["steps"] += ".parquet"
    io.write_parquet(trade.job_steps(spark, SMALL), paths["steps"])
    args = [x for n, p in paths.items() for x in (f"--{n}", p)]
    job.main([*args, "--last-fiscal-year", str(trade.LAST_FISCAL_YEAR)])

    out = {p.name: spark.read.parquet(str(p)) for p in (tmp_path / "out").iterdir() if p.name != "next_year_csv"}
    assert rows(out["train"]) == rows(q.train_frame(spark, SMALL).select(*out["train"].columns))
    assert out["score"].count() == 28 and out["importances"].count() == 52
    cells = out["confusion_train"].unionByName(out["confusion_test"])
    assert cells.agg(F.sum(F.col("predicted_0") + F.col("predicted_1"))).first()[0] == out["train"].count()
    coming = spark.read.csv(str(tmp_path / "out" / "next_year_csv"), header=True, inferSchema=True)
    assert coming.agg(F.sum("pred")).first()[0] == out["predicted_total"].first()[0]
    assert PolicyConfig().last_fiscal_year == 2018


def test_several_last_period_rows_stay(spark, rows):
    """Two titles, a differing adjustment check, two birth dates: each gives a second row."""
    checks = payroll(
        spark,
        {},
        {"JOB_CLASS_TITLE": "CHIEF"},
        {"EMPLOYEE_ID": 2},
        {"EMPLOYEE_ID": 2, "CHECK_TYPE": "Adjustment", "WORK_SCHEDULE": "40"},
        {"EMPLOYEE_ID": 3},
        {"EMPLOYEE_ID": 3, "DATE_OF_BIRTH": "16-MAR-55"},
    )
    years = ey.with_fiscal_year(checks, settle_lookup(calendar(spark, YEARS), "cal"))
    panel, *_ = panel_rows(years, settle(ey.spells(years), "spells"))
    assert rows(panel.groupBy("EMPLOYEE_ID").count()) == [(1, 2), (2, 2), (3, 2)]


def test_checks_without_an_employee_are_refused(spark):
    checks = payroll(spark, {}, {"EMPLOYEE_ID": 2}, {"EMPLOYEE_ID": 3})
    checks = checks.withColumn("EMPLOYEE_ID", F.when(F.col("EMPLOYEE_ID") == 1, F.col("EMPLOYEE_ID")))
    with pytest.raises(ValueError, match="2 checks have no EMPLOYEE_ID"):
        build_history(checks, calendar(spark, YEARS), step_rows(spark))


def test_nan_pay_is_missing_and_infinite_pay_refused(spark):
    found = build_history(payroll(spark, {"HW_TYPE_PAY": float("nan")}), calendar(spark, YEARS), step_rows(spark))
    assert found.panel.select("OT_TYPE_PAY_PERSENT").first()[0] is None
    with pytest.raises(Exception, match="HW_TYPE_PAY is infinite"):
        build_history(payroll(spark, {"HW_TYPE_PAY": float("inf")}), calendar(spark, YEARS), step_rows(spark))


def test_bare_rows_fit_as_the_whole_ones(spark, rows):
    """What is only fitted or searched is written without the frame's other columns."""
    frame = settle(q.train_frame(spark, SMALL), "frame")
    bare, whole = modelling.bare_rows(frame, "bare", q.CFG), modelling.model_rows(frame, "whole", q.CFG)
    assert bare.columns == ["EMPLOYEE_ID", "FISCAL_YEAR", "label", "weight", "is_train", "row_hash", "features"]
    assert rows(bare) == rows(whole.select(*bare.columns)) and set(frame.columns) < set(whole.columns)
    assert q.training_rows(spark, SMALL).columns == bare.columns


def test_dates_are_spelled_once_a_person(spark, rows):
    """They are made of the person alone, so before the checks are joined to it; where the checks move again, after that."""
    plain = trade.payroll(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    several = trade.payroll(spark, SMALL, True)._jdf.queryExecution().optimizedPlan().toString()
    assert plain.index("date_format") > plain.rindex("Join") and several.rindex("date_format") < several.index("Join")
    columns = ["EMPLOYEE_ID", "DATE_OF_BIRTH", "ORIGINAL_HIRE_DATE"]
    assert rows(trade.payroll(spark, SMALL).select(*columns).distinct()) == rows(trade.payroll(spark, SMALL, True).select(*columns).distinct())
