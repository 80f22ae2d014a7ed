"""How many rows each rule drops on the way from the panel to the frames.

The counts come from tables that the frames are filtered from anyway, by the columns that the rules read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.functions.dates import parse_dmy
from tenurelens.operators import encode, salary
from tenurelens.operators.employee_year import retire_label
from tenurelens.plans.frames import Fitted, Scored
from tenurelens.plans.history import History

Rule = tuple[str, Column]


def counted(rows: DataFrame, frame: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule, in their order: frame, step (from 1), rule, rows_in, dropped. A row falls to the first rule it meets."""
    first = F.lit(0)
    for step, (_, met) in reversed(list(enumerate(rules, start=1))):
        first = F.when(F.coalesce(met, F.lit(False)), step).otherwise(first)
    marked = rows.select(first.alias("step"))
    wide = marked.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("step") == i).alias(f"n{i}") for i in range(1, len(rules) + 1)])
    before, entries = F.col("rows"), []
    for i, (name, _) in enumerate(rules, start=1):
        entries.append(F.struct(F.lit(frame).alias("frame"), F.lit(i).alias("step"), F.lit(name).alias("rule"), before.alias("rows_in"), F.col(f"n{i}").alias("dropped")))
        before = before - F.col(f"n{i}")
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def report(history: History, fitted: Fitted, scored: Scored, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Rows as the joins made them: an employee-year that was multiplied counts as often."""
    label = retire_label(cfg)
    panel = counted(
        history.rows,
        "panel",
        [
            ("no readable hire date", parse_dmy("ORIGINAL_HIRE_DATE").isNull()),
            ("unknown status or reason", label.isNull()),
            ("left for another reason", label == 2),
        ],
    )
    train = counted(fitted.rows, "train", [("no rate", salary.no_rate()), ("no overtime share", salary.no_share())])
    score = counted(scored.rows, "score", [("no overtime share", salary.no_share()), ("unseen step", encode.unseen_step())])
    return panel.unionByName(train).unionByName(score)
