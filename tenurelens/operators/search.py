"""Grid search over forests: stratified folds, one row per finished fit, scores from these rows.

A fit is known by its forest and the fold it leaves out. What it is remembered by are the four counts
of its confusion matrix, from which the score of any beta follows. So points that mean the same forest share their
fits, in all stages and for all betas, and a search that was stopped goes on with what is missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.functions.hashing import key_hash
from tenurelens.functions.nullsafe import ieee_div
from tenurelens.operators.forest import FIT_COLUMNS, ROW_KEY, ForestParams, Stage, stable_layout, stages
from tenurelens.operators.ranking import ranked
from tenurelens.sources.workspace import scratch_path, settle

POINT = ["beta", "stage", "point", "trees", "depth", "min_split", "min_leaf", "max_features"]
FIT = ["trees", "depth", "least", "max_features"]
COUNTS = ["tp", "fp", "fn", "tn"]
POINTS = "beta double, stage int, point int, trees int, depth int, min_split int, min_leaf int, max_features string, least int, by_size boolean"
FINISHED = "data string, trees int, depth int, least int, max_features string, fold int, tp long, fp long, fn long, tn long"


# -- folds --------------------------------------------------------------------


def with_folds(rows: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """``rows`` with ``fold``, 0 to ``folds`` - 1: dealt out in turn within each label by the order of a
    hash of the row key, so that the folds of a label differ by one row at most."""
    order = [*ROW_KEY, "row_hash"]
    hashed = rows.withColumn("__hash", key_hash(cfg.forest_seed, *ROW_KEY))
    placed = ranked(hashed, ["label"], ["__hash", *order], "__place")
    return placed.withColumn("fold", (F.col("__place") % cfg.folds).cast("int")).drop("__hash", "__place")


def fingerprint(folded: DataFrame) -> str:
    """The same for the same rows in the same folds, in any order."""
    row = F.xxhash64(*ROW_KEY, "row_hash", "label", "fold").cast("decimal(20,0)")
    n, total = folded.agg(F.count(F.lit(1)), F.sum(row)).first()
    return f"{n}:{total}"


# -- points -------------------------------------------------------------------


def fit_key(p: ForestParams) -> tuple:
    return (p.trees, p.depth, p.min_instances, p.features)


@dataclass(frozen=True)
class Grid:
    """Stages by beta. The first stage weighs folds by their rows, the others weigh them alike."""

    stages: dict[float, Sequence[Stage]]

    @classmethod
    def full(cls, betas: Sequence[float]) -> Grid:
        return cls({beta: stages(beta) for beta in betas})

    def points(self, spark: SparkSession) -> DataFrame:
        rows = [
            (beta, s, i, p.trees, p.depth, p.min_split, p.min_leaf, p.features, p.min_instances, stage.by_size)
            for beta, some in self.stages.items()
            for s, stage in enumerate(some, start=1)
            for i, p in enumerate(stage.points(), start=1)
        ]
        return spark.createDataFrame(rows, POINTS)

    def fits(self) -> dict[tuple, ForestParams]:
        """One forest for all points that mean it, in the order of the search."""
        found: dict[tuple, ForestParams] = {}
        for some in self.stages.values():
            for stage in some:
                for p in stage.points():
                    found.setdefault(fit_key(p), p)
        return found


# -- fits ---------------------------------------------------------------------


class Memory:
    """A table of finished fits in a folder. Each fit adds its row when it is done; rows of other data are left alone."""

    def __init__(self, spark: SparkSession, folder: str, data: str):
        self.spark, self.folder, self.data = spark, folder, data
        spark.createDataFrame([], FINISHED).write.mode("append").parquet(folder)

    def rows(self) -> DataFrame:
        """Finished fits of this data; a fit that was done twice counts once."""
        own = self.spark.read.schema(FINISHED).parquet(self.folder).where(F.col("data") == self.data)
        return own.dropDuplicates([*FIT, "fold"]).drop("data")

    def done(self) -> set[tuple]:
        return {tuple(r) for r in self.rows().select(*FIT, "fold").collect()}

    def add(self, key: tuple, fold: int, counts: Sequence[int]) -> None:
        self.spark.createDataFrame([(self.data, *key, fold, *counts)], FINISHED).coalesce(1).write.mode("append").parquet(self.folder)


def evaluate(rows: DataFrame, params: ForestParams, fold: int, cfg: PolicyConfig = PolicyConfig()) -> list[int]:
    """Counts on the fold's rows by a forest fitted on all others: hits, false alarms, misses, right refusals."""
    model = params.estimator(cfg).fit(rows.where(F.col("fold") != fold))
    said = model.transform(rows.where(F.col("fold") == fold))
    actual, found = F.col("label") == 1, F.col("prediction") == 1
    cells = (actual & found, ~actual & found, actual & ~found, ~actual & ~found)
    return list(said.agg(*[F.count_if(c) for c in cells]).first())


def run_fits(rows: DataFrame, grid: Grid, memory: Memory, cfg: PolicyConfig = PolicyConfig(), parallelism: int = 4) -> int:
    """Fits what ``memory`` does not hold yet; the number of fits. One that fails stops the search, and those done stay."""
    done = memory.done()
    todo = [(key, p, fold) for key, p in grid.fits().items() for fold in range(cfg.folds) if (*key, fold) not in done]

    def one(job: tuple) -> tuple:
        key, params, fold = job
        return key, fold, evaluate(rows, params, fold, cfg)

    with ThreadPool(parallelism) as pool:
        # fits run side by side; their rows are written one after the other, as appends to one folder have to be
        for finished in pool.imap_unordered(one, todo):
            memory.add(*finished)
    return len(todo)


# -- scores -------------------------------------------------------------------


def fold_scores(points: DataFrame, finished: DataFrame) -> DataFrame:
    """One row per point and fold: its counts and F-beta of class 1, 0 without a hit."""
    square = F.col("beta") * F.col("beta")
    hit = (square + 1) * F.col("tp")
    score = F.coalesce(ieee_div(hit, hit + square * F.col("fn") + F.col("fp")), F.lit(0.0))
    # both sides have a row per point or fit, some thousands at most
    return points.join(finished, FIT).select(*POINT, "by_size", "fold", *COUNTS, score.alias("score"))


def point_scores(folds: DataFrame) -> DataFrame:
    """One row per point: folds, mean and spread of their scores, rank within beta and stage, equal means in the order of the points."""
    size = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    weight = F.when(F.col("by_size"), size).otherwise(1)
    mean = F.sum(F.col("score") * weight) / F.sum(weight)
    found = folds.groupBy(*POINT).agg(F.count(F.lit(1)).alias("folds"), mean.alias("mean_score"), F.stddev_pop("score").alias("std_score"))
    order = Window.partitionBy("beta", "stage").orderBy(F.desc("mean_score"), "point")
    return found.withColumn("rank", F.row_number().over(order))


@dataclass(frozen=True)
class Search:
    folds: DataFrame
    points: DataFrame
    #: Fits of this run; the others were remembered.
    fitted: int

    def best(self) -> DataFrame:
        """The best point of every stage of every beta."""
        return self.points.where("rank = 1")


def search(
    rows: DataFrame, grid: Grid, cfg: PolicyConfig = PolicyConfig(), folder: str | None = None, partitions: int | None = None, parallelism: int = 4
) -> Search:
    """Scores of all points of ``grid`` over assembled training rows.

    ``folder`` keeps the finished fits; a search of the same rows with the same folder goes on where one stopped.
    """
    spark = rows.sparkSession
    folded = settle(with_folds(rows.select(*ROW_KEY, "row_hash", *FIT_COLUMNS), cfg), "folds")
    training = stable_layout(folded, partitions or cfg.fit_partitions).select(*FIT_COLUMNS, "fold").persist()
    try:
        data = f"{fingerprint(folded)}:{cfg.forest_seed}:{cfg.folds}:{partitions or cfg.fit_partitions}"
        memory = Memory(spark, folder or scratch_path(spark, "finished-fits"), data)
        fitted = run_fits(training, grid, memory, cfg, parallelism)
    finally:
        training.unpersist()
    folds = settle(fold_scores(grid.points(spark), memory.rows()), "fold-scores")
    return Search(folds.drop("by_size"), point_scores(folds), fitted)
