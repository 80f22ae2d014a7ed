"""Retirement eligibility, pension estimate and peer-group statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.functions.nullsafe import ieee_div, three_valued
from tenurelens.operators.employee_year import LAST_PERIOD
from tenurelens.operators.joins import lookup_join, null_safe_join
from tenurelens.sources.workspace import Lookup

PEER_KEYS = ["FISCAL_YEAR", "FMS_DEPARTMENT_TITLE", "JOB_CLASS_TITLE"]
PENSION = ["retirement_factor", "retirement_pension"]


def is_eligible(cfg: PolicyConfig = PolicyConfig()) -> Column:
    return (F.col("age") >= cfg.eligible_age) & (F.col("service_year") >= cfg.eligible_service)


def is_newly_eligible(cfg: PolicyConfig = PolicyConfig()) -> Column:
    """Not eligible yet, but one year older and longer in service they will be."""
    age, service = F.col("age"), F.col("service_year")
    return ((age == cfg.forward_age) & (service >= cfg.forward_service)) | (
        (age >= cfg.eligible_age) & (service == cfg.forward_service)
    )


def eligible_flag(min_age: int, min_service: int) -> Column:
    return three_valued((F.col("age") >= min_age) & (F.col("service_year") >= min_service))


# -- pension ------------------------------------------------------------------


def retirement_factor(cfg: PolicyConfig = PolicyConfig()) -> Column:
    early = F.col("service_year") < cfg.full_factor_service
    chain = reduce(
        lambda c, rule: c.when((F.col("age") == rule[0]) & early, rule[1]),
        cfg.retirement_factors,
        F,
    )
    return chain.otherwise(F.lit(1.0))


def pension_amount(rate: Column, cfg: PolicyConfig = PolicyConfig()) -> Column:
    monthly = rate * cfg.pays_per_year / cfg.months_per_year
    return monthly * F.col("service_year") * F.col("retirement_factor") * cfg.accrual


def with_pension(frame: DataFrame, cfg: PolicyConfig = PolicyConfig(), growth: float | None = None) -> DataFrame:
    """Pension columns from the row's own ``BIWEEKLY_RATE``, which is dropped."""
    rate = F.col("BIWEEKLY_RATE")
    rate = rate if growth is None else rate * growth
    frame = frame.withColumn("retirement_factor", retirement_factor(cfg))
    return frame.withColumn("retirement_pension", pension_amount(rate, cfg)).drop("BIWEEKLY_RATE")


def pension_table(
    frame: DataFrame,
    rates: DataFrame,
    cfg: PolicyConfig = PolicyConfig(),
    growth: float | None = None,
    how: str = "left",
) -> DataFrame:
    """One row per frame row and distinct rate at its last period."""
    base = frame.select("EMPLOYEE_ID", "FISCAL_YEAR", "MAX_PP", "age", "service_year")
    return with_pension(null_safe_join(base, rates, LAST_PERIOD, how), cfg, growth)


def attach_pension(frame: DataFrame, pension: DataFrame, how: str = "left") -> DataFrame:
    """Join back on employee and period; repeated keys repeat rows.

    A table made from ``frame`` holds all of its keys, so ``how="inner"`` gives
    the same rows and lets Spark split a hot key on either side.
    """
    table = pension.select("EMPLOYEE_ID", "MAX_PP", *PENSION)
    return null_safe_join(frame, table, ["EMPLOYEE_ID", "MAX_PP"], how)


# -- peers --------------------------------------------------------------------


def eligible_counts(panel: DataFrame, min_age: int, min_service: int) -> DataFrame:
    """Distinct employees by year, department, title and eligibility flag."""
    flag = eligible_flag(min_age, min_service).alias("whether_eligible")
    people = panel.select(*PEER_KEYS, flag, "EMPLOYEE_ID").distinct()
    return people.groupBy(*PEER_KEYS, "whether_eligible").agg(F.count(F.lit(1)).alias("ecount"))


def pivot_eligible(counts: DataFrame) -> DataFrame:
    """One column per flag value; a flag without employees stays NULL."""
    return counts.groupBy(*PEER_KEYS).pivot("whether_eligible", [0, 1]).agg(F.max("ecount"))


def peer_share(wide: DataFrame) -> DataFrame:
    filled = wide.fillna(0, ["0", "1"])
    total = F.col("1") + F.col("0")
    return filled.select(
        *PEER_KEYS,
        ieee_div(F.col("1").cast("double"), total.cast("double")).alias("eligible_persent"),
        total.alias("total_ecount"),
    )


def peer_stats(panel: DataFrame, min_age: int, min_service: int) -> DataFrame:
    return peer_share(pivot_eligible(eligible_counts(panel, min_age, min_service)))


def attach_peers(frame: DataFrame, peers: Lookup, by_year: bool = True) -> DataFrame:
    """``by_year=False`` for a frame already moved on to the next year."""
    keys = PEER_KEYS if by_year else PEER_KEYS[1:]
    kept = Lookup(peers.frame.select(*keys, "eligible_persent", "total_ecount"), peers.rows)
    return lookup_join(frame, kept, keys)
