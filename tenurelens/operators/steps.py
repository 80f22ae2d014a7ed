"""Highest pay step, headroom below it, and the repair of negative headroom."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.functions.nullsafe import in_list
from tenurelens.operators.joins import lookup_join
from tenurelens.sources.workspace import Lookup


STEP_KEYS = ["JOB", "JOB_CLASS_TITLE", "PAY_GRADE"]
PANEL_STEP_KEYS = [("JOB_CLASS", "JOB"), "JOB_CLASS_TITLE", "PAY_GRADE"]


def unambiguous(steps: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Drop the listed titles, or (title, grade) pairs, from the step table."""
    title, grade = F.col("JOB_CLASS_TITLE"), F.col("PAY_GRADE")
    keep = [
        title != t if g is None else (title != t) | (grade != g) for t, g in cfg.ambiguous_jobs
    ]
    return steps.filter(reduce(lambda a, b: a & b, keep))


def step_table(steps: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Usable rows of the step table, one per distinct content, numeric job."""
    known = unambiguous(steps.filter(F.col("HIGHEST_STEP").isNotNull()), cfg)
    return known.select(
        F.col("JOB").try_cast("int").alias("JOB"), "JOB_CLASS_TITLE", "PAY_GRADE", "HIGHEST_STEP"
    ).distinct()


def attach_steps(panel: DataFrame, steps: Lookup) -> DataFrame:
    return lookup_join(panel, steps, PANEL_STEP_KEYS)


def repeated_jobs(steps: Lookup) -> DataFrame:
    """Keys for which the step table has more than one highest step."""
    twice = steps.frame.groupBy(*STEP_KEYS).count().filter("count > 1")
    return twice.select(*STEP_KEYS, F.lit(True).alias("repeated"))


def step_default(cfg: PolicyConfig = PolicyConfig()) -> Column:
    """The known highest step, else the default of the job class."""
    by_class = reduce(
        lambda chain, rule: chain.when(in_list("JOB_CLASS", rule[1]), rule[0]),
        cfg.step_defaults,
        F,
    )
    return F.coalesce(F.col("HIGHEST_STEP"), by_class.otherwise(cfg.step_default_else)).cast("int")


def headroom(highest: Column, step: Column) -> dict[str, Column]:
    gap = highest - step
    return {
        "dif_step": gap.cast("int"),
        "whether_highest": F.when(gap == 0, 1).when(gap != 0, 0).cast("int"),
    }


def with_headroom(frame: DataFrame) -> DataFrame:
    return frame.withColumns(headroom(F.col("HIGHEST_STEP"), F.col("SALARY_STEP")))


def step_repair() -> Column:
    """A larger highest step where the salary step exceeds it.

    Judged on the headroom before any repair: 12 becomes 15; 0 becomes the first
    of 5, 8, 12 that reaches the salary step; 2 and 6 become 8.
    """
    highest, step = F.col("HIGHEST_STEP"), F.col("SALARY_STEP")
    raised = (
        F.when(highest == 12, 15)
        .when((highest == 0) & (step <= 5), 5)
        .when((highest == 0) & (step <= 8), 8)
        .when((highest == 0) & (step <= 12), 12)
        .when(highest.isin(2, 6), 8)
        .otherwise(highest)
    )
    return F.when(highest - step < 0, raised).otherwise(highest).cast("int")


def with_steps(panel: DataFrame, steps: Lookup, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    frame = attach_steps(panel, steps).withColumn("HIGHEST_STEP", step_default(cfg))
    return with_headroom(frame.withColumn("HIGHEST_STEP", step_repair()))
