"""Split, weights, fit, evaluation and grid of the forest."""

import pytest
from pyspark.sql import functions as F

from tenurelens.config import PolicyConfig
from tenurelens.operators import encode, forest, search
from tenurelens.operators.forest import FEATURES, ForestParams
from tenurelens.plans import modelling

CFG = PolicyConfig()


@pytest.fixture(scope="module")
def frame(spark):
    """Model-shaped rows derived from the part and order tables."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    base = orders.select(
        F.col("o_orderkey").alias("EMPLOYEE_ID"),
        F.lit(2018).alias("FISCAL_YEAR"),
        (F.col("o_totalprice") > 300000).cast("int").alias("retire"),
        F.col("o_totalprice").alias("RATE_PP"),
        F.when(F.col("o_custkey") % 9 != 0, F.lit(float("inf"))).alias("RATE_PP_ESTIMATE"),
        *[F.col("o_orderpriority").alias(c) for c in encode.HASHED if c != "MOU"],
        (F.col("o_custkey") % 30).cast("int").alias("MOU"),
    )
    hashed = encode.hash_encode(base)
    rest = [c for c in FEATURES if c not in hashed.columns]
    return hashed.select("*", *[(F.col("EMPLOYEE_ID") % (i + 2)).alias(c) for i, c in enumerate(rest)])


@pytest.fixture(scope="module")
def rows_(frame):
    return forest.assemble(frame).persist()


def test_fifty_two_features():
    assert len(FEATURES) == len(set(FEATURES)) == 52


def test_every_feature_is_finite(rows_):
    vectors = [r["features"].toArray() for r in rows_.collect()]
    assert {len(v) for v in vectors} == {52}
    estimate = {v[FEATURES.index("RATE_PP_ESTIMATE")] for v in vectors}
    assert estimate == {1e18, -1.0}


def test_split_is_stable_and_near_the_share(frame):
    split = forest.with_split(frame, CFG)
    again = forest.with_split(frame.repartition(5), CFG)
    assert dict(split.select("EMPLOYEE_ID", "is_train").collect()) == dict(again.select("EMPLOYEE_ID", "is_train").collect())
    share = split.agg(F.avg(F.col("is_train").cast("int"))).first()[0]
    assert 0.75 < share < 0.85


def test_weights(spark):
    df = spark.createDataFrame([(0,), (1,)], "retire int").select(forest.class_weight())
    assert [r[0] for r in df.collect()] == [1.0, 5.0]


def test_same_rows_in_another_order_give_the_same_forest(rows_):
    params = ForestParams(trees=5, depth=3, min_split=20, min_leaf=5)
    one = forest.fit(forest.stable_layout(rows_, 4), params)
    two = forest.fit(forest.stable_layout(rows_.repartition(7), 4), params)
    assert one.featureImportances == two.featureImportances
    assert one.toDebugString.split("\n")[1:] == two.toDebugString.split("\n")[1:]


@pytest.fixture(scope="module")
def predictions(rows_):
    model = forest.fit(forest.stable_layout(rows_.filter("is_train"), 4), ForestParams(trees=10, depth=4, min_split=20, min_leaf=5))
    return model, model.transform(rows_).persist()


def test_importances(spark, predictions):
    found = forest.importances(spark, predictions[0]).collect()
    assert sum(r["importance"] for r in found) == pytest.approx(1.0)
    values = [r["importance"] for r in found]
    assert values == sorted(values, reverse=True)
    assert {r["feature"] for r in found} == set(FEATURES)
    assert found[0]["feature"] == "RATE_PP"


def test_confusion_cells_add_up(predictions):
    said = predictions[1]
    assert {r[0] for r in said.select("prediction").distinct().collect()} <= {0.0, 1.0}
    cells = forest.confusion(said).collect()
    assert sum(r["predicted_0"] + r["predicted_1"] for r in cells) == said.count()


def test_fbeta_equals_the_evaluator(predictions):
    said = predictions[1]
    found = {r["beta"]: r["fbeta"] for r in forest.fbeta(said, CFG.betas).collect()}
    for beta in CFG.betas:
        assert found[beta] == pytest.approx(forest.evaluator(beta).evaluate(said))


def test_fbeta_without_a_hit_is_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    assert [r["fbeta"] for r in forest.fbeta(df, (0.5, 0.3)).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("beta, depth", [(0.5, 15), (0.3, 3)])
def test_full_grid(beta, depth):
    stages = forest.stages(beta)
    assert [len(s.points()) for s in stages] == [9, 88, 140, 11]
    assert {p.depth for p in stages[2].points()} == {depth}
    assert stages[3].points()[0].features == "2" and stages[3].points()[-1].features == "32"
    # the split bound has no counterpart, so many points are the same forest
    assert len({search.fit_key(p) for p in stages[2].points()}) == 17


def test_train_and_score(frame):
    frame = frame.drop(*encode.HASHED_COLUMNS)
    trained = modelling.train(frame, ForestParams(trees=5, depth=3, min_split=20, min_leaf=5))
    scored = trained.score(frame.drop("retire"))
    assert scored.columns == [*frame.drop("retire").columns, "pred"]
    assert scored.count() == frame.count()
    total = modelling.predicted_total(scored).first()[0]
    assert total == trained.predictions().filter("prediction = 1").count()


def test_layout_does_not_follow_the_session(spark, rows_):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    params, found = ForestParams(trees=5, depth=3, min_split=20, min_leaf=5), []
    try:
        for n in ("4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            model = forest.fit(forest.stable_layout(rows_), params)
            found.append([r.prediction for r in model.transform(rows_).orderBy("EMPLOYEE_ID", "FISCAL_YEAR", "row_hash").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_deep_forests_keep_the_rows_nodes_and_grow_the_same_trees(rows_):
    params = ForestParams(trees=5, depth=8, min_split=4, min_leaf=2)
    layout = forest.stable_layout(rows_.filter("is_train"), 4).persist()
    kept = params.estimator()
    assert kept.getCacheNodeIds() and not ForestParams(depth=3).estimator().getCacheNodeIds()
    trees = [e.fit(layout).toDebugString.split("\n", 1)[1] for e in (kept, params.estimator().setCacheNodeIds(False))]
    layout.unpersist()
    assert trees[0] == trees[1]


def test_a_fit_holds_only_what_it_reads(rows_, monkeypatch):
    held = []
    monkeypatch.setattr(forest, "fit", lambda rows, *_: held.append(rows.columns))
    modelling.fit_rows(rows_, ForestParams())
    assert held == [forest.FIT_COLUMNS]


def test_a_beta_without_a_search_is_refused():
    with pytest.raises(ValueError, match="no search for beta"):
        forest.stages(0.7)
