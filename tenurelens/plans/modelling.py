"""Train on the eligible years, evaluate, score the next year."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.operators import encode, forest, search
from tenurelens.sources.workspace import settle


def model_rows(frame: DataFrame, name: str, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """The frame's columns with hashed and assembled features, written once: the fit reads them many times."""
    return settle(assembled(frame, cfg), name)


def bare_rows(frame: DataFrame, name: str, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """``model_rows`` without the frame's other columns, for a fit or search whose rows are not listed afterwards."""
    return settle(assembled(frame, cfg, keep=()), name)


def assembled(frame: DataFrame, cfg: PolicyConfig = PolicyConfig(), keep: Sequence[str] | None = None) -> DataFrame:
    """Hashed by a dictionary of the frame's texts, for which it is read once more: best a written table. By default it keeps all columns."""
    hashed = encode.hash_encode(frame, encode.TextDictionary.of(frame))
    kept = frame.columns if keep is None else keep
    return forest.assemble(hashed, cfg, keep=[c for c in kept if c not in forest.ROW_KEY])


@dataclass(frozen=True)
class Trained:
    model: RandomForestClassificationModel
    rows: DataFrame

    def predictions(self) -> DataFrame:
        """Training and test rows with all their columns, ``is_train`` and ``prediction``."""
        return self.model.transform(self.rows)

    def score(self, frame: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
        """``frame`` with ``pred``: a row stands for itself also where its key occurs again."""
        said = self.model.transform(assembled(frame, cfg))
        return said.select(*frame.columns, F.col("prediction").cast("int").alias("pred"))


def train(
    frame: DataFrame,
    params: forest.ForestParams = forest.FINAL_FORESTS[-1],
    cfg: PolicyConfig = PolicyConfig(),
    partitions: int | None = None,
) -> Trained:
    return fit_rows(model_rows(frame, "model_rows", cfg), params, cfg, partitions)


def fit_rows(
    rows: DataFrame,
    params: forest.ForestParams,
    cfg: PolicyConfig = PolicyConfig(),
    partitions: int | None = None,
) -> Trained:
    """Fit on the training part of assembled rows."""
    training = forest.stable_layout(rows.filter("is_train"), partitions or cfg.fit_partitions).select(*forest.FIT_COLUMNS).persist()
    try:
        return Trained(forest.fit(training, params, cfg), rows)
    finally:
        training.unpersist()


def tune(
    rows: DataFrame,
    betas: Sequence[float],
    cfg: PolicyConfig = PolicyConfig(),
    stages: Sequence[forest.Stage] | None = None,
    folder: str | None = None,
    partitions: int | None = None,
    parallelism: int = 4,
) -> search.Search:
    """All search stages for each beta; by default the full grid of 248 points. ``folder`` remembers finished fits."""
    grid = search.Grid({beta: stages for beta in betas}) if stages else search.Grid.full(betas)
    return search.search(rows.filter("is_train"), grid, cfg, folder, partitions, parallelism)


def predicted_total(scored: DataFrame) -> DataFrame:
    return scored.agg(F.sum("pred").alias("predicted_total"))
