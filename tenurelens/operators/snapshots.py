"""What the joins on the last period multiply: counted before they run, refused in strict mode.

An employee-year takes its attributes from its last period by four joins, on distinct rows of
different columns, and meets its own pension rows once more. Where a period holds several such
rows, the joins multiply: ``a * b * c`` rows from snapshot, unit and job class, and with ``d`` rates
``(a * b * c) ** 2 * d`` after the pension join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.operators.joins import null_safe_join
from tenurelens.sources.schema import SNAPSHOT
from tenurelens.sources.workspace import settle, settle_measured

LITERAL, STRICT = "literal", "strict"
KEY = ["EMPLOYEE_ID", "MAX_PP"]
PERIOD = ["EMPLOYEE_ID", "PAYROLL_SEQUENCE"]
GROUPS = {"snapshots": SNAPSHOT, "units": ["MOU"], "classes": ["JOB_CLASS"], "rates": ["BIWEEKLY_RATE"]}
#: Keys that a refusal names.
NAMED = 5


class AmbiguousSnapshots(ValueError):
    """The last periods do not give one attribute row each."""


@dataclass(frozen=True)
class SnapshotReport:
    """Panel rows, keys whose joins multiply, and rows after the attribute joins and after the pension join.

    The rows are those of the whole panel, before it is filtered by eligibility.
    """

    employee_years: int
    ambiguous: int
    snapshot_rows: int
    pension_rows: int

    @property
    def factor(self) -> float:
        """Rows after all joins to each employee-year."""
        return self.pension_rows / self.employee_years if self.employee_years else 1.0

    def frame(self, spark: SparkSession) -> DataFrame:
        row = (self.employee_years, self.ambiguous, self.snapshot_rows, self.pension_rows, self.factor)
        return spark.createDataFrame([row], "employee_years long, ambiguous long, snapshot_rows long, pension_rows long, factor double")


def multiplicities(panel: DataFrame, states: DataFrame) -> DataFrame:
    """Per employee and last period: panel rows, distinct rows of each attribute group, and rows after the joins.

    ``states`` holds attribute rows by ``EMPLOYEE_ID`` and ``PAYROLL_SEQUENCE``, in any number.
    """
    wanted = null_safe_join(states, panel.select(*KEY).distinct(), ["EMPLOYEE_ID", ("PAYROLL_SEQUENCE", "MAX_PP")], "left_semi")
    columns = [c for some in GROUPS.values() for c in some]
    return counted(panel, settle(wanted.select(*PERIOD, *columns).distinct(), "states_at_last"))


def distinct_at(states: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct attribute rows per employee and period, dealt out by these two: joins on them and counts by them need no other shuffle."""
    return states.select(*PERIOD, *columns).repartition(*PERIOD).distinct()


def counted(panel: DataFrame, states: DataFrame) -> DataFrame:
    """``multiplicities`` over written ``states``, which may hold other periods, too.

    Each attribute group is counted by itself from its own columns; counting all at once would shuffle every state once a group.
    """
    found = panel.groupBy(*KEY).agg(F.count(F.lit(1)).alias("people"))
    for name, columns in GROUPS.items():
        counts = distinct_at(states, columns).groupBy(*PERIOD).agg(F.count(F.lit(1)).alias(name))
        found = null_safe_join(found, counts, ["EMPLOYEE_ID", ("MAX_PP", "PAYROLL_SEQUENCE")], "inner")
    rows = F.col("people") * F.col("snapshots") * F.col("units") * F.col("classes")
    joined = found.withColumn("panel_rows", rows)
    return joined.withColumn("pension_rows", F.col("panel_rows") * F.col("panel_rows") * F.col("rates"))


def multiplied() -> Column:
    return F.col("pension_rows") > 1


def measure(panel: DataFrame, states: DataFrame, single: int = 0) -> tuple[SnapshotReport, DataFrame]:
    """The report, and the keys whose joins multiply, from written ``states``; ``single`` more rows are known to have one attribute row."""
    counts, seen = settle_measured(
        counted(panel, states),
        "multiplicities",
        people=F.sum("people"),
        ambiguous=F.count_if(multiplied()),
        panel_rows=F.sum("panel_rows"),
        pension_rows=F.sum("pension_rows"),
    )
    report = SnapshotReport(single + seen["people"], seen["ambiguous"], single + seen["panel_rows"], single + seen["pension_rows"])
    return report, counts.where(multiplied())


def accept(report: SnapshotReport, ambiguous: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> None:
    """Refuse what the mode does not allow, before any join has run: in strict mode every
    multiplied key, in literal mode a factor above ``fan_out_limit``, if there is one."""
    if cfg.snapshot_mode == STRICT:
        refused = report.ambiguous > 0
    elif cfg.snapshot_mode == LITERAL:
        refused = cfg.fan_out_limit is not None and report.factor > cfg.fan_out_limit
    else:
        raise ValueError(f"snapshot_mode is {LITERAL} or {STRICT}, not {cfg.snapshot_mode}")
    if not refused:
        return
    some = ambiguous.orderBy(F.desc("pension_rows"), *KEY).limit(NAMED).collect()
    named = ", ".join(f"employee {r['EMPLOYEE_ID']} in period {r['MAX_PP']} ({r['pension_rows']} rows)" for r in some)
    raise AmbiguousSnapshots(
        f"{report.ambiguous} of {report.employee_years} employee-years have several attribute rows in their last period; "
        f"the joins would make {report.pension_rows} rows, {report.factor:.2f} to each; most: {named}"
    )
