"""Every query against its SQL, and the plans the queries should have."""

import statistics

import duckdb
import pytest

import __spark_entry__ as contract
from checks import oracle, queries as q
from tenurelens.operators import employee_year as ey
from tenurelens.operators.encode import TargetMeans
from tenurelens.sources.workspace import settle
from tests.conftest import SMALL
from tools.compare import TABLES, kinds, table

QUERIES, SQL = q.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


def test_only_the_model_has_no_sql():
    assert set(QUERIES) - set(SQL) == {
        "rf_fit", "rf_fit_deep", "rf_predict_all", "feature_importance", "rf_score", "agg_predicted_total", "grid_search", "grid_results",
    }
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    expected = found.fetchall()
    described = {c[0]: c[1] for c in duck.execute(f"describe {SQL[name]}").fetchall()}
    assert kinds(dict(df.dtypes)) == kinds(described)
    assert table(df.columns, df.collect()) == table(columns, expected)


def test_the_contract_holds_every_query():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() == 5


def test_score_is_one_row_per_person(spark):
    scored = QUERIES["rf_score"](spark, SMALL).collect()
    assert len({r["EMPLOYEE_ID"] for r in scored}) == len(scored) == 28
    assert {r["pred"] for r in scored} <= {0, 1}


def test_every_forest_counts_every_row(spark):
    found = QUERIES["rf_fit_deep"](spark, SMALL).collect()
    for features in ("8", "20"):
        assert sum(r["predicted_0"] + r["predicted_1"] for r in found if r["max_features"] == features) == 198
    everyone = QUERIES["rf_predict_all"](spark, SMALL)
    assert everyone.count() == 198 and not everyone.filter("pred is null or retire is null").count()


def test_grid_results_lists_every_fold(spark):
    found = QUERIES["grid_results"](spark, SMALL).collect()
    assert len(found) == 11 * 5 and {r["rank"] for r in found} == set(range(1, 12))
    for point in {r["point"] for r in found}:
        scores = [r["score"] for r in found if r["point"] == point]
        mean, spread = next((r["mean_score"], r["std_score"]) for r in found if r["point"] == point)
        assert mean == pytest.approx(sum(scores) / 5) and spread == pytest.approx(statistics.pstdev(scores))


# -- plans --------------------------------------------------------------------


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["agg_last_period", "agg_salary_summary", "hash_all", "target_mean_job", "train_frame"])
def test_no_python_in_the_plan(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "Python" not in text and "Pandas" not in text


def test_scan_reads_only_what_the_query_needs(spark):
    text = plan(QUERIES["agg_last_period"](spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in text
    assert "l_extendedprice" not in text


def test_checks_are_shuffled_once_for_the_spells(spark):
    checks = q.checks(spark, SMALL)
    spelled = plan(ey.spells(checks, q.CFG))
    # one exchange more than the join that makes the checks of the test tables
    assert spelled.count("Exchange hashpartitioning") == plan(checks).count("Exchange hashpartitioning") + 1
    assert "SortAggregate" not in spelled


def test_target_means_take_one_aggregation(spark):
    base = settle(q.eligible(spark, SMALL), "eligible")
    means = TargetMeans.fit(base, cfg=q.CFG)
    text = plan(means.apply(base))
    assert text.count("BroadcastHashJoin") >= len(means.sets)
    assert "SortMergeJoin" not in text


def test_eligible_counts_do_not_gather_employees(spark):
    text = plan(q.agg_eligible_counts(spark, SMALL))
    assert "EMPLOYEE_ID" in text and "collect_set" not in text
