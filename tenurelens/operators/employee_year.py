"""From pay-period checks to one labelled row per employee and fiscal year."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.functions.dates import birth_date, hire_date, next_year_start, parse_dmy, whole_years
from tenurelens.functions.nullsafe import fixed_parts, in_list, known, strict_max
from tenurelens.operators.joins import BROADCAST_ROWS, lookup_join, null_safe_join
from tenurelens.operators.snapshots import SnapshotReport, accept, distinct_at, measure
from tenurelens.sources.schema import PANEL_KEYS, SNAPSHOT
from tenurelens.sources.workspace import Lookup, settle, settle_measured

LAST_PERIOD = ["EMPLOYEE_ID", ("MAX_PP", "PAYROLL_SEQUENCE")]


def with_fiscal_year(checks: DataFrame, calendar: Lookup) -> DataFrame:
    years = Lookup(calendar.frame.select("PAYROLL_SEQUENCE", "FISCAL_YEAR"), calendar.rows)
    return lookup_join(checks, years, ["PAYROLL_SEQUENCE"])


def regular(checks: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    return checks.filter(F.col("CHECK_TYPE") == cfg.regular_check)


def last_period(checks: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Last regular pay period of each employee and fiscal year."""
    return (
        regular(checks, cfg)
        .groupBy(*PANEL_KEYS)
        .agg(strict_max("PAYROLL_SEQUENCE").cast("int").alias("MAX_PP"))
    )


def snapshot(checks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct attribute rows per employee and pay period, all check types."""
    return checks.select("EMPLOYEE_ID", "PAYROLL_SEQUENCE", *columns).distinct()


def attach_last_period(
    panel: DataFrame, checks: DataFrame, columns: Sequence[str], how: str = "left"
) -> DataFrame:
    """Attributes at ``MAX_PP``. Several distinct rows there multiply the panel row.

    A panel taken from ``checks`` always finds its own period, so ``how="inner"``
    gives the same rows and lets Spark split a hot key on either side.
    """
    return null_safe_join(panel, snapshot(checks, columns), LAST_PERIOD, how)


# -- the panel from its last periods -------------------------------------

STATE = [*SNAPSHOT, "MOU", "JOB_CLASS", "BIWEEKLY_RATE"]
YEAR = ["FISCAL_YEAR", "EMPLOYEE_ID"]
PERSON = ["DATE_OF_BIRTH", "ORIGINAL_HIRE_DATE"]
MEASURES = ["HW_TYPE_HOURS", "OT_TYPE_HOURS", "HW_TYPE_PAY", "OT_TYPE_PAY"]


def spells(checks: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Checks rolled up to the attribute combinations of each employee-year.

    Regular checks of a combination become one row with its last period; other
    checks keep their period in ``other_pp``. Each row carries the number of
    checks and the fixed-point sums from which the salary statistics follow. Since the keys
    hold every attribute, checks shrink before they are shuffled and no
    employee's checks gather in one task.
    """
    is_regular = F.col("CHECK_TYPE").eqNullSafe(cfg.regular_check)
    period = F.col("PAYROLL_SEQUENCE")
    return (
        checks.withColumn("other_pp", F.when(~is_regular, period))
        .groupBy(*YEAR, *PERSON, *STATE, "other_pp")
        .agg(
            F.max(period).alias("last_pp"),
            F.count(F.lit(1)).alias("checks"),
            *[F.count(known(c)).alias(f"n_{c}") for c in MEASURES],
            *[
                F.sum(part).alias(f"{name}_{c}")
                for c in MEASURES
                for name, part in zip(("high", "low"), fixed_parts(c, cfg.sum_decimals))
            ],
        )
    )


@dataclass(frozen=True)
class SnapshotPanel:
    """Panel rows with their last-period attributes.

    ``single`` rows are alone at their ``MAX_PP``, have one attribute row there and carry its rate.
    ``multiple`` rows come from the joins; their rates stay in ``rates`` because
    a row may meet several. Both are None when no such employee-year exists.
    ``report`` says what the joins multiply.
    """

    single: DataFrame
    report: SnapshotReport
    multiple: DataFrame | None = None
    rates: DataFrame | None = None


#: Stands for a missing period in keys; no period is so large.
NO_PERIOD = 1 << 40


def _keyed(frame: DataFrame, period: str) -> DataFrame:
    """With ``__pp``, the period as a key in which missing ones match."""
    return frame.withColumn("__pp", F.coalesce(F.col(period).cast("long"), F.lit(NO_PERIOD)))


PERIOD_KEY = ["EMPLOYEE_ID", "__pp"]


def last_periods(checks: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """``last_period`` with the number of all checks; ``MAX_PP`` and ``regular`` are those of regular checks.

    Reads no attributes, and every check shrinks to its employee-year before it is shuffled.
    """
    period = F.col("PAYROLL_SEQUENCE")
    # a check without a period belongs to the year that has none, whatever its type
    counted = F.col("CHECK_TYPE").eqNullSafe(cfg.regular_check) | period.isNull()
    return checks.groupBy(*PANEL_KEYS).agg(
        F.max(F.when(counted, period)).alias("MAX_PP"), F.count_if(counted).alias("regular"), F.count(F.lit(1)).alias("checks")
    )


def last_periods_of_spells(spelled: DataFrame) -> DataFrame:
    """The same from the spells of the checks."""
    counted = F.col("other_pp").isNull()
    return spelled.groupBy(*PANEL_KEYS).agg(
        F.max(F.when(counted, F.col("last_pp"))).alias("MAX_PP"),
        F.sum(F.when(counted, F.col("checks")).otherwise(0)).alias("regular"),
        F.sum("checks").alias("checks"),
    )


def states_at_last(checks: DataFrame, panel: DataFrame, rows: int) -> DataFrame:
    """Distinct attribute rows at the panel's last periods, all check types.

    A panel of ``rows`` rows is broadcast if it is small. Else the checks are shuffled once, by employee and period, and
    streamed past the panel's keys; rows that stay are told apart where they are, so neither step sorts the checks.
    """
    wanted = panel.select(*PERIOD_KEY)
    wanted = F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    states = _keyed(checks.select("EMPLOYEE_ID", "PAYROLL_SEQUENCE", *STATE), "PAYROLL_SEQUENCE")
    return states.join(wanted, PERIOD_KEY, "left_semi").distinct()


def snapshot_panel(
    checks: DataFrame, spelled: DataFrame | None = None, cfg: PolicyConfig = PolicyConfig()
) -> SnapshotPanel:
    """Equal to ``last_period`` followed by the attribute joins, row for row.

    Last periods come first, from ``spelled`` if the checks' spells are at hand; only attributes there are looked at.
    A panel row alone at its last period that finds one attribute row there takes it by one join; for the others, how far the
    attribute joins will multiply is counted first, and ``cfg.snapshot_mode`` decides what is refused.
    """
    return panel_at_last(checks, written_last_periods(checks, spelled, cfg), cfg)


def written_last_periods(checks: DataFrame, spelled: DataFrame | None = None, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    found = last_periods(checks, cfg) if spelled is None else last_periods_of_spells(spelled)
    return settle(found, "last_periods")


def panel_at_last(checks: DataFrame, last: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> SnapshotPanel:
    panel = _keyed(last.filter("regular > 0").drop("regular", "checks"), "MAX_PP")
    at_last = settle(states_at_last(checks, panel, panel.count()), "open_periods")
    states = at_last.groupBy(*PERIOD_KEY).agg(F.count(F.lit(1)).alias("states"))
    people = panel.groupBy(*PERIOD_KEY).agg(F.count(F.lit(1)).alias("people"))
    alone = (F.col("people") == 1) & (F.col("states") == 1)
    keys, seen = settle_measured(
        people.join(states, PERIOD_KEY).select(*PERIOD_KEY, alone.alias("alone")),
        "last_keys",
        single=F.count_if("alone"),
        several=F.count_if(~F.col("alone")),
    )
    single = seen["single"]
    if not seen["several"]:
        rows = panel.join(at_last.drop("PAYROLL_SEQUENCE"), PERIOD_KEY)
        return SnapshotPanel(rows.drop("__pp"), SnapshotReport(single, 0, single, single))

    several, others = keys.filter(~F.col("alone")), keys.filter("alone")
    done = panel.join(others.select(*PERIOD_KEY), PERIOD_KEY, "left_semi").join(at_last.drop("PAYROLL_SEQUENCE"), PERIOD_KEY).drop("__pp")
    rows = panel.join(several.select(*PERIOD_KEY), PERIOD_KEY, "left_semi").drop("__pp")
    open_periods = at_last.drop("__pp")
    report, ambiguous = measure(rows, open_periods, single)
    accept(report, ambiguous, cfg)
    for columns in (SNAPSHOT, ["MOU"], ["JOB_CLASS"]):
        rows = null_safe_join(rows, distinct_at(open_periods, columns), LAST_PERIOD, "inner")
    # rates of these rows only: who is alone has theirs in the row
    theirs = at_last.join(several.select(*PERIOD_KEY), PERIOD_KEY, "left_semi")
    return SnapshotPanel(done, report, rows, snapshot(theirs, ["BIWEEKLY_RATE"]))


# -- columns ------------------------------------------------------------------


def with_ages(panel: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Parse both dates, repair centuries, drop rows without a hire date."""
    parsed = panel.withColumns({c: parse_dmy(c) for c in PERSON})
    repaired = parsed.filter(F.col("ORIGINAL_HIRE_DATE").isNotNull()).withColumns(
        {
            "DATE_OF_BIRTH": birth_date("DATE_OF_BIRTH", cfg),
            "ORIGINAL_HIRE_DATE": hire_date("ORIGINAL_HIRE_DATE", cfg),
            "next_fy_startdate": next_year_start("FISCAL_YEAR", cfg),
        }
    )
    return repaired.withColumns(
        {
            "age": whole_years("next_fy_startdate", "DATE_OF_BIRTH", cfg),
            "service_year": whole_years("next_fy_startdate", "ORIGINAL_HIRE_DATE", cfg),
        }
    )


def retire_label(cfg: PolicyConfig = PolicyConfig()) -> Column:
    """0 active, 1 retired, 2 left otherwise; NULL when either input is unknown."""
    status, reason = F.col("JOB_STATUS"), F.col("SEPARATION_REASON")
    return (
        F.when(status.isNull(), None)
        .when(status == cfg.active_status, 0)
        .when(reason.isNull(), None)
        .when(reason == cfg.retired_reason, 1)
        .otherwise(2)
        .cast("int")
    )


def with_label(panel: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Add ``retire`` and drop those who left for another reason or unknown."""
    labelled = panel.withColumn("retire", retire_label(cfg)).filter(F.col("retire") != 2)
    return labelled.drop("JOB_STATUS", "SEPARATION_REASON")


def supervisor_flag(cfg: PolicyConfig = PolicyConfig()) -> Column:
    return in_list("MOU", cfg.supervisor_units).cast("int")
