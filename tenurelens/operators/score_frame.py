"""The last known year moved one year ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.operators.eligibility import is_eligible, is_newly_eligible
from tenurelens.operators.steps import with_headroom


def last_year_active(panel: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    return panel.filter((F.col("FISCAL_YEAR") == cfg.last_fiscal_year) & (F.col("retire") == 0))


def score_population(panel: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Still eligible plus newly eligible; the two conditions exclude each other."""
    return last_year_active(panel, cfg).filter(is_eligible(cfg) | is_newly_eligible(cfg))


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def rolled_step() -> Column:
    step = F.col("SALARY_STEP")
    return F.when(F.col("whether_highest") == 0, step + 1).otherwise(step).cast("int")


def roll_forward(frame: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Year, age and service +1; a step up if there is one; pay grows."""
    moved = frame.withColumns(
        {
            "FISCAL_YEAR": F.col("FISCAL_YEAR") + 1,
            "age": F.col("age") + 1,
            "service_year": F.col("service_year") + 1,
            "SALARY_STEP": rolled_step(),
            "RATE_PP": F.col("RATE_PP") * cfg.rate_growth,
            "RATE_PP_ESTIMATE": F.col("RATE_PP_ESTIMATE") * cfg.rate_growth,
        }
    )
    return with_headroom(moved)
