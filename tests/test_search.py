"""Folds, fits that are remembered, and scores of folds and points."""

import statistics
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tenurelens.config import PolicyConfig
from tenurelens.operators import search
from tenurelens.operators.forest import ForestParams, Stage
from tenurelens.operators.ranking import ranked
from tenurelens.sources.workspace import scratch_path, settle

CFG = replace(PolicyConfig(), folds=3, fit_partitions=4)
STAGE = Stage(ForestParams(trees=3, min_leaf=2), {"depth": (2, 3), "min_split": (9, 10, 40)})


@pytest.fixture(scope="module")
def rows(spark):
    def row(i):
        label = float(i * 37 % 101 > 70)
        return i, 2018, label, 1.0 + 4 * label, i * 7919 % 1000, Vectors.dense(label * 3 + i % 5, i % 7, i % 11)

    made = spark.createDataFrame([row(i) for i in range(400)], ["EMPLOYEE_ID", "FISCAL_YEAR", "label", "weight", "row_hash", "features"])
    return settle(made, "search_rows")


def test_places_in_groups_of_any_size(spark):
    made = spark.createDataFrame([(g, i * 7 % 13) for g, n in ((None, 5), ("a", 400), ("b", 1)) for i in range(n)], "g string, v int")
    table = settle(made.repartition(6), "ranked")
    found = Counter((r.g, r.v, r.place) for r in ranked(table, ["g"], ["v"]).collect())
    expected = Counter()
    for g in (None, "a", "b"):
        values = sorted(r.v for r in made.collect() if r.g == g)
        expected.update((g, v, i) for i, v in enumerate(values))
    assert found == expected
    assert ranked(table.limit(0), ["g"], ["v"]).count() == 0


def test_equal_rows_are_dealt_to_several_ranges(spark):
    table = settle(spark.range(0, 50_000, 1, 8).select(F.lit(1).alias("g"), F.lit(2).alias("v")), "equal")
    found = ranked(table, ["g"], ["v"])
    assert found.select("place").distinct().count() == 50_000 and found.agg(F.max("place")).first()[0] == 49_999


def test_folds_of_a_label_differ_by_one_row_at_most(rows):
    found = search.with_folds(rows, CFG)
    assert found.count() == rows.count() and set(found.columns) == {*rows.columns, "fold"}
    for label in (0.0, 1.0):
        sizes = [r["count"] for r in found.where(F.col("label") == label).groupBy("fold").count().collect()]
        assert len(sizes) == CFG.folds and max(sizes) - min(sizes) <= 1
    again = search.with_folds(rows.repartition(5), CFG)
    assert search.fingerprint(found) == search.fingerprint(again) != search.fingerprint(found.limit(399))


def test_every_fold_of_every_point_has_a_row(rows):
    found = search.search(rows, search.Grid({0.5: [STAGE], 0.3: [STAGE]}), CFG)
    folds, points = found.folds.collect(), found.points.collect()
    # 9 and 10 mean the same forest, and the betas share it
    assert found.fitted == 4 * 3 and len(folds) == 12 * 3 and len(points) == 12
    for r in folds:
        b = r["beta"] ** 2
        hit = (1 + b) * r["tp"]
        assert r["score"] == pytest.approx(hit / (hit + b * r["fn"] + r["fp"]) if hit else 0.0)
        assert 132 <= r["tp"] + r["fp"] + r["fn"] + r["tn"] <= 135
    for p in points:
        scores = [r["score"] for r in folds if (r["beta"], r["point"]) == (p["beta"], p["point"])]
        assert p["mean_score"] == pytest.approx(statistics.mean(scores)) and p["std_score"] == pytest.approx(statistics.pstdev(scores)) and p["folds"] == 3
    for beta in (0.5, 0.3):
        ordered = sorted((p for p in points if p["beta"] == beta), key=lambda p: p["rank"])
        assert [p["rank"] for p in ordered] == list(range(1, 7))
        assert [(-p["mean_score"], p["point"]) for p in ordered] == sorted((-p["mean_score"], p["point"]) for p in ordered)
    assert {(r["beta"], r["rank"]) for r in found.best().collect()} == {(0.5, 1), (0.3, 1)}


def test_means_by_size_follow_the_rows(spark):
    folds = [(0.5, 1, 1, 1, 1, 1, 1, "2", True, f, n, 0, 0, 0, s) for f, n, s in ((0, 10, 1.0), (1, 30, 0.0))]
    names = [*search.POINT, "by_size", "fold", *search.COUNTS, "score"]
    assert search.point_scores(spark.createDataFrame(folds, names)).first()["mean_score"] == pytest.approx(0.25)
    alike = spark.createDataFrame(folds, names).withColumn("by_size", F.lit(False))
    assert search.point_scores(alike).first()["mean_score"] == pytest.approx(0.5)


def test_a_stopped_search_goes_on_with_what_is_missing(spark, rows, monkeypatch):
    grid, folder = search.Grid({0.5: [STAGE]}), scratch_path(spark, "memory")
    real, calls = search.evaluate, []

    def stops(*args):
        if len(calls) == 5:
            raise RuntimeError("stopped")
        calls.append(args)
        return real(*args)

    monkeypatch.setattr(search, "evaluate", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        search.search(rows, grid, CFG, folder, parallelism=1)
    monkeypatch.setattr(search, "evaluate", real)
    rest = search.search(rows, grid, CFG, folder)
    assert rest.fitted == 12 - 5
    whole = search.search(rows, grid, CFG)
    assert whole.fitted == 12
    assert sorted(map(tuple, rest.folds.collect())) == sorted(map(tuple, whole.folds.collect()))
    assert search.search(rows, grid, CFG, folder).fitted == 0
    # other rows don't count as finished
    assert search.search(rows.where("EMPLOYEE_ID > 0"), search.Grid({0.5: [Stage(STAGE.base, {"depth": (2,)})]}), CFG, folder).fitted == 3


def test_the_whole_grid_has_496_points(spark):
    grid = search.Grid.full((0.5, 0.3))
    points = grid.points(spark)
    assert points.count() == 496 and points.where("stage = 1 and not by_size or stage > 1 and by_size").isEmpty()
    assert len(grid.fits()) < 496


def test_folds_are_dealt_without_the_frames_other_columns(rows, monkeypatch):
    """The dealing writes and sorts its rows, so it gets only what a fit reads."""
    dealt = []
    monkeypatch.setattr(search, "ranked", lambda some, *rest: dealt.append(some.columns) or ranked(some, *rest))
    grid = search.Grid({0.5: [Stage(STAGE.base, {"depth": (2,)})]})
    wide = rows.withColumns({f"other_{i}": F.lit("text") for i in range(3)})
    found = search.search(wide, grid, CFG)
    assert dealt == [["EMPLOYEE_ID", "FISCAL_YEAR", "row_hash", "label", "weight", "features", "__hash"]]
    assert sorted(found.folds.collect()) == sorted(search.search(rows, grid, CFG).folds.collect())
