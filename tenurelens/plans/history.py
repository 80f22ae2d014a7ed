"""The labelled employee-year panel and the salary statistics beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.operators import employee_year as ey, salary, steps
from tenurelens.operators.joins import lookup_join
from tenurelens.operators.snapshots import NAMED, STRICT, AmbiguousSnapshots, SnapshotReport
from tenurelens.sources.io import clean_numbers
from tenurelens.sources.schema import PANEL
from tenurelens.sources.workspace import Lookup, remove, scratch_path, settle, settle_at, settle_lookup


@dataclass(frozen=True)
class History:
    """What the training and the scoring frame share.

    ``panel`` is written by fiscal year. Its rows carry ``BIWEEKLY_RATE`` where
    ``single`` is true; the others find their rates in ``rates``. ``report`` counts what
    the joins on the last period multiply; step rows are not part of it. ``rows`` are the panel's rows
    before any is dropped.
    """

    panel: DataFrame
    rates: DataFrame | None
    fallback: Lookup
    report: SnapshotReport
    rows: DataFrame


def build_history(
    payroll: DataFrame, calendar: DataFrame, job_steps: DataFrame, cfg: PolicyConfig = PolicyConfig()
) -> History:
    checks = ey.with_fiscal_year(clean_numbers(payroll), _checked(calendar))
    ladder = settle_lookup(steps.step_table(job_steps, cfg), "job_steps")
    spark = payroll.sparkSession
    at, paid_at = scratch_path(spark, "checks"), scratch_path(spark, "salaries")
    checks = settle_at(checks, at)
    salaries = settle_at(salary.summary(checks, cfg), paid_at)
    every, rates, report = panel_rows(checks, cfg=cfg)
    # the panel reads what was written of the last periods
    remove(spark, at)
    rows, rates = _steps_apart(every, rates, ladder, cfg)
    rows = ey.with_label(ey.with_ages(rows, cfg), cfg)
    rows = salary.attach(rows, salaries).withColumn("whether_supervisor", ey.supervisor_flag(cfg))
    rows = steps.with_steps(rows, ladder, cfg).select(*PANEL, "BIWEEKLY_RATE", "single")
    panel = settle(rows, "history", partition_by=["FISCAL_YEAR"])
    # few columns, joined several times
    rates = None if rates is None else settle(rates, "rates")
    fallback = settle_lookup(salary.fallback(salaries, cfg), "fallback")
    remove(spark, paid_at)
    return History(panel, rates, fallback, report, every)


def panel_rows(
    checks: DataFrame, spelled: DataFrame | None = None, cfg: PolicyConfig = PolicyConfig()
) -> tuple[DataFrame, DataFrame | None, SnapshotReport]:
    """Employee-years with their last-period attributes, the rates of those with several rows there, and how far these multiply."""
    last = ey.written_last_periods(checks, spelled, cfg)
    unnamed = last.filter(F.col("EMPLOYEE_ID").isNull()).agg(F.sum("checks")).first()[0]
    if unnamed:
        raise ValueError(f"{unnamed} checks have no EMPLOYEE_ID")
    found = ey.panel_at_last(checks, last, cfg)
    rows = found.single.withColumn("single", F.lit(True))
    if found.multiple is not None:
        others = found.multiple.withColumns(
            {"BIWEEKLY_RATE": F.lit(None).cast("double"), "single": F.lit(False)}
        )
        rows = rows.unionByName(others)
    return rows, found.rates, found.report


def _checked(calendar: DataFrame) -> Lookup:
    """The calendar, refused if it would count a check twice."""
    table = settle(calendar, "calendar")
    rows, periods = table.agg(F.count(F.lit(1)), F.count_distinct("PAYROLL_SEQUENCE")).first()
    if periods < rows:
        raise ValueError("the fiscal calendar holds a pay period more than once")
    return Lookup(table, rows)


def _steps_apart(
    rows: DataFrame, rates: DataFrame | None, ladder: Lookup, cfg: PolicyConfig
) -> tuple[DataFrame, DataFrame | None]:
    """Rows the step table will repeat are no longer ``single``.

    The pension join multiplies them, so their rates move to the rate table. Strict
    mode refuses such a table.
    """
    repeated = settle_lookup(steps.repeated_jobs(ladder), "repeated_jobs")
    if not repeated.rows:
        return rows, rates
    if cfg.snapshot_mode == STRICT:
        some = repeated.frame.orderBy(*steps.STEP_KEYS).limit(NAMED).collect()
        named = ", ".join(str(tuple(r[k] for k in steps.STEP_KEYS)) for r in some)
        raise AmbiguousSnapshots(f"{repeated.rows} jobs have several highest steps: {named}")
    marked = lookup_join(rows, repeated, steps.PANEL_STEP_KEYS)
    split = F.col("single") & F.col("repeated").isNotNull()
    moved = marked.filter(split).select(
        "EMPLOYEE_ID", F.col("MAX_PP").alias("PAYROLL_SEQUENCE"), "BIWEEKLY_RATE"
    )
    kept = marked.withColumns(
        {"BIWEEKLY_RATE": F.when(~split, F.col("BIWEEKLY_RATE")), "single": F.col("single") & ~split}
    )
    return kept.drop("repeated"), moved if rates is None else rates.unionByName(moved)
