"""Inputs, fit, tuning and evaluation of the class-weighted random forest."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.functions.hashing import key_bucket
from tenurelens.functions.nullsafe import ieee_div
from tenurelens.operators.encode import HASHED_COLUMNS, TARGET_MEANS
from tenurelens.sources.schema import SALARY_STATS

ROW_KEY = ["EMPLOYEE_ID", "FISCAL_YEAR"]

FEATURES = [
    "FISCAL_YEAR",
    "age",
    "service_year",
    "SALARY_STEP",
    *SALARY_STATS,
    "whether_supervisor",
    "HIGHEST_STEP",
    "dif_step",
    "whether_highest",
    "retirement_factor",
    "retirement_pension",
    "eligible_persent",
    "total_ecount",
    *TARGET_MEANS,
    *HASHED_COLUMNS,
]


#: What a fit reads of its rows, once they are laid out.
FIT_COLUMNS = ["label", "weight", "features"]

#: Levels up to which each pass walks every row down its trees; deeper forests keep the rows' nodes from pass to pass.
WALKED_LEVELS = 5


def feature_columns(columns: Sequence[str], excluded: Sequence[str] = ("retire", "EMPLOYEE_ID")) -> list[str]:
    return [c for c in columns if c not in excluded]


# -- rows ---------------------------------------------------------------------


def split_bucket(cfg: PolicyConfig = PolicyConfig()) -> Column:
    """0..99 from the row key and the seed; the split is below ``train_percent``."""
    return key_bucket(100, cfg.split_seed, *ROW_KEY)


def with_split(frame: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    return frame.withColumn("is_train", split_bucket(cfg) < cfg.train_percent)


def class_weight(label: str = "retire", cfg: PolicyConfig = PolicyConfig()) -> Column:
    return reduce(lambda c, w: c.when(F.col(label) == w[0], w[1]), cfg.class_weights, F).cast("double")


def feature_value(name: str, cfg: PolicyConfig = PolicyConfig()) -> Column:
    """A finite double: missing values get a number, infinities a large one; others stay."""
    value = F.col(name).cast("double")
    infinite = F.when(value > 0, cfg.infinite_feature).otherwise(-cfg.infinite_feature)
    return (
        F.when(value.isNull() | F.isnan(value), cfg.missing_feature)
        .when(F.abs(value) == float("inf"), infinite)
        .otherwise(value)
    )


def assemble(frame: DataFrame, cfg: PolicyConfig = PolicyConfig(), keep: Sequence[str] = ()) -> DataFrame:
    """Row key, label and weight where known, split, row hash, feature vector."""
    kept = [*ROW_KEY, *keep]
    features = {c: feature_value(c, cfg) for c in FEATURES}
    labels = []
    if "retire" in frame.columns:
        labels = [F.col("retire").cast("double").alias("label"), class_weight(cfg=cfg).alias("weight")]
    values = frame.select(
        *kept,
        *labels,
        (split_bucket(cfg) < cfg.train_percent).alias("is_train"),
        F.xxhash64(*features.values()).alias("row_hash"),
        *[value.alias(f"x_{c}") for c, value in features.items()],
    )
    vectors = VectorAssembler(inputCols=[f"x_{c}" for c in FEATURES], outputCol="features")
    return vectors.transform(values).drop(*[f"x_{c}" for c in FEATURES])


def stable_layout(rows: DataFrame, partitions: int = PolicyConfig.fit_partitions) -> DataFrame:
    """Same rows, same partitions, same order on every run and session, for a seeded fit.

    The row hash spreads an employee-year that was multiplied by a join.
    """
    order = [*ROW_KEY, "row_hash"]
    return rows.repartition(partitions, *order).sortWithinPartitions(*order)


# -- fit ----------------------------------------------------------------------


@dataclass(frozen=True)
class ForestParams:
    """``min_split`` has no counterpart here: half of it bounds the leaf size."""

    trees: int = 100
    depth: int = 3
    min_split: int = 130
    min_leaf: int = 40
    features: str = "8"

    @property
    def min_instances(self) -> int:
        return max(self.min_leaf, math.ceil(self.min_split / 2))

    def estimator(self, cfg: PolicyConfig = PolicyConfig()) -> RandomForestClassifier:
        return RandomForestClassifier(
            labelCol="label",
            featuresCol="features",
            weightCol="weight",
            numTrees=self.trees,
            maxDepth=self.depth,
            minInstancesPerNode=self.min_instances,
            featureSubsetStrategy=self.features,
            seed=cfg.forest_seed,
            maxMemoryInMB=1024,
            # the same trees either way
            cacheNodeIds=self.depth > WALKED_LEVELS,
        )


# The three forests that were fitted after tuning; the last scores.
FINAL_FORESTS = (
    ForestParams(100, 15, 60, 10, "8"),
    ForestParams(100, 15, 110, 10, "20"),
    ForestParams(100, 3, 130, 40, "8"),
)


def fit(rows: DataFrame, params: ForestParams = FINAL_FORESTS[-1], cfg: PolicyConfig = PolicyConfig()) -> RandomForestClassificationModel:
    return params.estimator(cfg).fit(rows)


def importances(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """Features by falling importance; the model holds one number per feature."""
    pairs = [(n, float(v)) for n, v in zip(FEATURES, model.featureImportances.toArray(), strict=True)]
    frame = spark.createDataFrame(pairs, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")


# -- evaluation ---------------------------------------------------------------


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    counts = predictions.groupBy(F.col(label).cast("int").alias("label")).agg(
        *[F.count(F.when(F.col(prediction) == p, 1)).alias(f"predicted_{p}") for p in (0, 1)]
    )
    return counts


def fbeta(predictions: DataFrame, betas: Sequence[float], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """F-beta of class 1 for every beta, from one pass over the predictions."""
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    counts = predictions.agg(
        F.count(F.when(actual & said, 1)).alias("tp"),
        F.count(F.when(~actual & said, 1)).alias("fp"),
        F.count(F.when(actual & ~said, 1)).alias("fn"),
    )
    beta = F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta")
    square = F.col("beta") * F.col("beta")
    hit = (square + 1) * F.col("tp")
    score = ieee_div(hit, hit + square * F.col("fn") + F.col("fp"))
    return counts.select(beta, "tp", "fp", "fn").withColumn("fbeta", F.coalesce(score, F.lit(0.0)))


def evaluator(beta: float) -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(
        labelCol="label", predictionCol="prediction", metricName="fMeasureByLabel", metricLabel=1.0, beta=beta
    )


# -- tuning -------------------------------------------------------------------


@dataclass(frozen=True)
class Stage:
    """Grid over some fields of ``ForestParams``, the rest as in ``base``; ``by_size`` weighs folds by their rows."""

    base: ForestParams
    grid: Mapping[str, Sequence]
    by_size: bool = False

    def points(self) -> list[ForestParams]:
        names = list(self.grid)
        return [
            ForestParams(**{**self.base.__dict__, **dict(zip(names, values))})
            for values in product(*self.grid.values())
        ]


# Ranges of the four search stages and what each holds constant.
def stages(beta: float) -> tuple[Stage, ...]:
    if beta not in (0.5, 0.3):
        raise ValueError(f"there is no search for beta {beta}")
    deep = beta == 0.5
    found = ForestParams(100, 15, 60, 10) if deep else ForestParams(100, 3, 130, 40)
    return (
        Stage(ForestParams(100, 10, 100, 20, "sqrt"), {"trees": range(100, 1000, 100)}, by_size=True),
        Stage(
            ForestParams(100, 10, 100, 20, "sqrt"),
            {"depth": range(3, 25, 2), "min_split": range(50, 201, 20)},
        ),
        Stage(
            ForestParams(100, found.depth, 100, 20, "sqrt"),
            {"min_split": range(50, 150, 10), "min_leaf": range(10, 150, 10)},
        ),
        Stage(found, {"features": [str(n) for n in range(2, 35, 3)]}),
    )
