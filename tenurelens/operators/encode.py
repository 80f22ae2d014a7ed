"""Category clean-up, target means and hashed text columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.functions.hashing import char_hash
from tenurelens.functions.nullsafe import in_list, strict_avg
from tenurelens.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join
from tenurelens.operators.profile import value_counts
from tenurelens.sources.workspace import Lookup, settle

# output column -> key columns
TARGET_MEANS: dict[str, tuple[str, ...]] = {
    "WORK_SCHEDULE_persent": ("WORK_SCHEDULE",),
    "RETIREMENT_PENSION_PLAN_persent": ("RETIREMENT_PENSION_PLAN",),
    "ETHNICITY_persent": ("ETHNICITY",),
    "GENDER_persent": ("GENDER",),
    "MARITAL_STATUS_persent": ("MARITAL_STATUS",),
    "MOU_persent": ("MOU",),
    "HSTEP_persent": ("HIGHEST_STEP",),
    "jclass_persent": ("FMS_DEPARTMENT_TITLE", "JOB_CLASS_TITLE"),
    "CSTEP_persent": ("HIGHEST_STEP", "SALARY_STEP"),
}

#: A text is looked up where it stands for so many rows, on average.
ROWS_OF_A_TEXT = 4

# text column -> (prefix, buckets)
HASHED: dict[str, tuple[str, int]] = {
    "JOB_CLASS_TITLE": ("jobclass", 3),
    "FMS_DEPARTMENT_TITLE": ("department", 3),
    "PAY_GRADE": ("paygrade", 3),
    "WORK_SCHEDULE": ("schedule", 3),
    "RETIREMENT_PENSION_PLAN": ("plan", 3),
    "ETHNICITY": ("ethnicity", 3),
    "GENDER": ("gender", 2),
    "MARITAL_STATUS": ("mstatus", 3),
    "MOU": ("mou", 3),
}


def normalised(column: str, cfg: PolicyConfig = PolicyConfig()) -> Column:
    for name, spellings, replacement in cfg.category_rules:
        if name == column:
            return F.when(in_list(column, spellings), replacement).otherwise(F.col(column))
    return F.col(column)


def normalise(frame: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    return frame.withColumns({name: normalised(name, cfg) for name, _, _ in cfg.category_rules})


def target_mean(frame: DataFrame, keys: Sequence[str], name: str, label: str = "retire") -> DataFrame:
    return frame.groupBy(*keys).agg(F.avg(label).alias(name))


@dataclass(frozen=True)
class TargetMeans:
    """Mean label per category, fitted once and applied to any frame.

    All key sets come from one grouping-sets aggregation. A NULL key is a
    category of its own; a category not seen in the fit gives NULL.
    """

    table: DataFrame
    sets: dict[str, int]
    rows: dict[str, int]
    cfg: PolicyConfig

    @classmethod
    def fit(cls, frame: DataFrame, label: str = "retire", cfg: PolicyConfig = PolicyConfig(), weight: str | None = None) -> TargetMeans:
        """``weight`` names a column of counts; a row stands for so many."""
        mean = F.avg(label)
        if weight is not None:
            times = F.when(F.col(label).isNotNull(), F.col(weight))
            mean = F.sum(F.col(label) * F.col(weight)).cast("double") / F.sum(times).cast("double")
        columns = list(dict.fromkeys(k for keys in TARGET_MEANS.values() for k in keys))
        means = frame.groupingSets([list(k) for k in TARGET_MEANS.values()], *columns).agg(
            F.grouping_id().alias("set_id"), mean.alias("target_mean")
        )
        # a column's bit in the set id is 0 where it takes part in the grouping
        sets = {
            name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)
            for name, keys in TARGET_MEANS.items()
        }
        table = settle(means, "target_means")
        sizes = dict(table.groupBy("set_id").count().collect())
        return cls(table, sets, {name: sizes.get(i, 0) for name, i in sets.items()}, cfg)

    def means(self, name: str) -> DataFrame:
        keys = TARGET_MEANS[name]
        own = self.table.filter(F.col("set_id") == self.sets[name])
        return own.select(*keys, F.col("target_mean").alias(name))

    def fallback(self, name: str = "jclass_persent") -> DataFrame:
        """Unweighted mean over the categories, for one not seen in the fit."""
        return mean_of_groups(self.means(name), name, self.cfg)

    def apply(self, frame: DataFrame, names: Sequence[str] = tuple(TARGET_MEANS)) -> DataFrame:
        for name in names:
            frame = lookup_join(frame, Lookup(self.means(name), self.rows[name]), TARGET_MEANS[name])
        return frame

    def apply_filled(self, frame: DataFrame) -> DataFrame:
        """Apply, and fill an unseen job class."""
        applied = self.apply(frame)
        job = F.coalesce(F.col("jclass_persent"), self.fallback().scalar())
        return applied.withColumn("jclass_persent", job)

    def apply_unseen(self, frame: DataFrame) -> DataFrame:
        """Apply, fill an unseen job class, drop rows with an unseen step pair."""
        return self.apply_filled(frame).filter(~unseen_step())


def unseen_step() -> Column:
    return F.col("CSTEP_persent").isNull()


def mean_of_groups(means: DataFrame, name: str, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    return means.agg(strict_avg(name, cfg.share_decimals).alias(f"{name}_fallback"))


def hashed_columns(column: str, text: str | None = None) -> list[Column]:
    """Hashed columns of a category, from its own column or from ``text``."""
    prefix, buckets = HASHED[column]
    return char_hash(F.col(text or column).cast("string"), buckets, prefix)


@dataclass(frozen=True)
class TextDictionary:
    """The distinct texts of every hashed column with their rows, written once.

    A column is hashed by its dictionary where a text stands for several rows; the
    others, and dictionaries that are too large to be sent to all tasks, are hashed row by row.
    """

    table: DataFrame
    sizes: dict[str, tuple[int, int, int]]

    @classmethod
    def of(cls, frame: DataFrame, columns: Sequence[str] = tuple(HASHED)) -> TextDictionary:
        table = settle(value_counts(frame, columns), "texts")
        length = F.coalesce(F.octet_length("value"), F.lit(0))
        sizes = table.groupBy("column_name").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows"), F.sum(length).alias("bytes"))
        return cls(table, {r["column_name"]: (r["texts"], r["rows"], r["bytes"]) for r in sizes.collect()})

    def worthwhile(self, column: str) -> bool:
        texts, rows, size = self.sizes.get(column, (0, 0, 0))
        few = texts <= BROADCAST_ROWS and size + 64 * texts <= BROADCAST_BYTES
        return few and 0 < texts * ROWS_OF_A_TEXT <= rows

    def lookup(self, column: str) -> Lookup:
        texts, _, size = self.sizes[column]
        own = self.table.filter(F.col("column_name") == column)
        return Lookup(own.select(F.col("value").alias("__text"), *hashed_columns(column, "value")), texts, size + 64 * texts)


def hash_encode(frame: DataFrame, texts: TextDictionary | None = None) -> DataFrame:
    """Append the hashed columns of every text category; ``MOU`` by its digits.

    With ``texts``, taken from the same rows, each distinct text is hashed once; the result is the same.
    """
    found = frame
    for name in HASHED:
        if texts is not None and texts.worthwhile(name):
            keyed = found.withColumn("__of", F.col(name).cast("string"))
            found = lookup_join(keyed, texts.lookup(name), [("__of", "__text")]).drop("__of")
        else:
            found = found.select("*", *hashed_columns(name))
    return found


HASHED_COLUMNS = [f"{prefix}_{b}" for prefix, n in HASHED.values() for b in range(n)]
