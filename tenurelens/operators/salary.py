"""Salary statistics per employee-year and their job-class fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.functions.nullsafe import fixed_parts, from_parts, ieee_div, known, strict_avg, strict_sum
from tenurelens.operators.joins import lookup_join, null_safe_join
from tenurelens.sources.schema import SALARY_KEYS, SALARY_STATS
from tenurelens.sources.workspace import Lookup

FALLBACK_KEYS = ["JOB_CLASS_TITLE", "SALARY_STEP"]
FALLBACK_STATS = [f"{c}2" for c in SALARY_STATS]


def active_regular(checks: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    return checks.filter(
        (F.col("JOB_STATUS") == cfg.active_status) & (F.col("CHECK_TYPE") == cfg.regular_check)
    )


def overtime_share(overtime: str, worked: str) -> Column:
    return ieee_div(F.col(overtime), F.col(overtime) + F.col(worked))


def rate_estimate(rate: str, overtime: str, worked: str) -> Column:
    return F.col(rate) + ieee_div(F.col(rate) * F.col(overtime), F.col(worked))


def summary(checks: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Mean rate and hours, summed pay, overtime share and estimated rate."""
    n = cfg.sum_decimals
    totals = (
        active_regular(checks, cfg)
        .groupBy(*SALARY_KEYS)
        .agg(
            strict_avg("BIWEEKLY_RATE", n).alias("RATE_PP"),
            strict_avg("HW_TYPE_HOURS", n).alias("HW_HOURS_PP"),
            strict_avg("OT_TYPE_HOURS", n).alias("OT_HOURS_PP"),
            strict_sum("HW_TYPE_PAY", n).alias("HW_TYPE_PAY"),
            strict_sum("OT_TYPE_PAY", n).alias("OT_TYPE_PAY"),
        )
    )
    return _with_ratios(totals)


def summary_of_spells(spelled: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """The same statistics from the sums the spells carry."""
    n = cfg.sum_decimals
    checks = F.sum("checks")

    def total(c: str) -> Column:
        complete = F.sum(f"n_{c}") == checks
        return F.when(complete, from_parts(F.sum(f"high_{c}"), F.sum(f"low_{c}"), n))

    high, low = (F.sum(part * F.col("checks")) for part in fixed_parts("BIWEEKLY_RATE", n))
    rated = F.count(known("BIWEEKLY_RATE")) == F.count(F.lit(1))
    regular = F.col("other_pp").isNull() & (F.col("JOB_STATUS") == cfg.active_status)
    totals = (
        spelled.filter(regular)
        .groupBy(*SALARY_KEYS)
        .agg(
            F.when(rated, from_parts(high, low, n) / checks).alias("RATE_PP"),
            (total("HW_TYPE_HOURS") / checks).alias("HW_HOURS_PP"),
            (total("OT_TYPE_HOURS") / checks).alias("OT_HOURS_PP"),
            total("HW_TYPE_PAY").alias("HW_TYPE_PAY"),
            total("OT_TYPE_PAY").alias("OT_TYPE_PAY"),
        )
    )
    return _with_ratios(totals)


def _with_ratios(totals: DataFrame) -> DataFrame:
    return totals.withColumns(
        {
            "OT_TYPE_PAY_PERSENT": overtime_share("OT_TYPE_PAY", "HW_TYPE_PAY"),
            "RATE_PP_ESTIMATE": rate_estimate("RATE_PP", "OT_TYPE_PAY", "HW_TYPE_PAY"),
        }
    )


def attach(panel: DataFrame, salaries: DataFrame) -> DataFrame:
    return null_safe_join(panel, salaries.select(*SALARY_KEYS, *SALARY_STATS), SALARY_KEYS)


def fallback(salaries: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Unweighted mean of the group means by title and step.

    The two ratios are ratios of the means, not means of the ratios.
    """
    n = cfg.mean_decimals
    sources = ["RATE_PP", "HW_HOURS_PP", "OT_HOURS_PP", "HW_TYPE_PAY", "OT_TYPE_PAY"]
    means = salaries.groupBy(*FALLBACK_KEYS).agg(*[strict_avg(c, n).alias(f"{c}2") for c in sources])
    return means.withColumns(
        {
            "OT_TYPE_PAY_PERSENT2": overtime_share("OT_TYPE_PAY2", "HW_TYPE_PAY2"),
            "RATE_PP_ESTIMATE2": rate_estimate("RATE_PP2", "OT_TYPE_PAY2", "HW_TYPE_PAY2"),
        }
    )


def attach_fallback(frame: DataFrame, means: Lookup) -> DataFrame:
    kept = Lookup(means.frame.select(*FALLBACK_KEYS, *FALLBACK_STATS), means.rows)
    return lookup_join(frame, kept, FALLBACK_KEYS)


def fill_train(frame: DataFrame) -> DataFrame:
    """Each of the five statistics falls back on its own."""
    filled = frame.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}2")) for c in SALARY_STATS})
    return filled.drop(*FALLBACK_STATS)


def fill_score(frame: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Only the share and the estimate fall back; only the estimate grows."""
    estimate = F.col("RATE_PP_ESTIMATE2") * cfg.rate_growth
    filled = frame.withColumns(
        {
            "OT_TYPE_PAY_PERSENT": F.coalesce("OT_TYPE_PAY_PERSENT", "OT_TYPE_PAY_PERSENT2"),
            "RATE_PP_ESTIMATE": F.coalesce(F.col("RATE_PP_ESTIMATE"), estimate),
        }
    )
    return filled.drop(*FALLBACK_STATS)


def no_rate() -> Column:
    return F.col("RATE_PP").isNull()


def no_share() -> Column:
    return F.col("OT_TYPE_PAY_PERSENT").isNull()


def impute_train(frame: DataFrame) -> DataFrame:
    """Filled rows; rate and share are required."""
    return fill_train(frame).filter(~no_rate() & ~no_share())


def impute_score(frame: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Filled rows; the share is required."""
    return fill_score(frame, cfg).filter(~no_share())
