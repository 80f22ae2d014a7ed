"""Eligibility, retirement factor, pension and peers."""

from itertools import product

import pytest

from tenurelens.config import PolicyConfig
from tenurelens.operators import eligibility as el, score_frame as sf
from tenurelens.sources.workspace import settle_lookup


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame(list(product(range(40, 70), range(0, 40))), "age int, service_year int")


def test_the_two_score_populations_exclude_each_other(grid):
    first = set(map(tuple, grid.filter(el.is_eligible()).collect()))
    second = set(map(tuple, grid.filter(el.is_newly_eligible()).collect()))
    assert not first & second
    assert first | second == {(a, s) for a, s in map(tuple, grid.collect()) if a >= 54 and s >= 9}


def test_retirement_factor(spark):
    early = {55: 0.925, 56: 0.94, 57: 0.955, 58: 0.97, 59: 0.985}
    df = spark.createDataFrame(list(product(range(50, 66), range(0, 36))), "age int, service_year int")
    for r in df.withColumn("f", el.retirement_factor()).collect():
        assert r["f"] == (early.get(r["age"], 1.0) if r["service_year"] < 30 else 1.0)


def test_pension_amount(spark):
    df = spark.createDataFrame([(1, 56, 20, 3000.0)], "EMPLOYEE_ID long, age int, service_year int, BIWEEKLY_RATE double")
    now, later = el.with_pension(df).first(), el.with_pension(df, growth=1.02).first()
    assert now["retirement_pension"] == pytest.approx(3000 * 26 / 12 * 20 * 0.94 * 0.0216)
    assert later["retirement_pension"] == pytest.approx(1.02 * now["retirement_pension"])
    assert "BIWEEKLY_RATE" not in now.asDict()


def test_pension_join_repeats_rows_of_a_repeated_key(spark):
    frame = spark.createDataFrame(
        [(1, 2018, 5, 60, 20), (1, 2018, 5, 60, 20), (2, 2018, 5, 60, 20)],
        "EMPLOYEE_ID long, FISCAL_YEAR int, MAX_PP int, age int, service_year int",
    )
    rates = spark.createDataFrame([(1, 5, 100.0), (1, 5, 200.0)], "EMPLOYEE_ID long, PAYROLL_SEQUENCE int, BIWEEKLY_RATE double")
    table = el.pension_table(frame, rates)
    assert table.count() == 5
    joined = el.attach_pension(frame, table)
    assert joined.filter("EMPLOYEE_ID = 1").count() == 8
    assert joined.filter("EMPLOYEE_ID = 2").select("retirement_pension").first()[0] is None


PEOPLE = [
    (2018, "D1", "T1", 60, 20, 1),
    (2018, "D1", "T1", 60, 20, 1),
    (2018, "D1", "T1", 40, 5, 2),
    (2018, "D1", "T2", 40, 5, 3),
    (2018, "D1", "T3", None, 12, 4),
    (2018, None, "T1", 54, 9, 5),
]
PANEL = "FISCAL_YEAR int, FMS_DEPARTMENT_TITLE string, JOB_CLASS_TITLE string, age int, service_year int, EMPLOYEE_ID long"


def test_peer_stats(spark):
    panel = spark.createDataFrame(PEOPLE, PANEL)
    found = {tuple(r)[1:3]: tuple(r)[3:] for r in el.peer_stats(panel, 55, 10).collect()}
    assert found == {
        ("D1", "T1"): (0.5, 2),
        ("D1", "T2"): (0.0, 1),
        ("D1", "T3"): (None, 0),  # nobody's flag is known
        (None, "T1"): (0.0, 1),
    }
    forward = {tuple(r)[1:3]: tuple(r)[3:] for r in el.peer_stats(panel, 54, 9).collect()}
    assert forward[(None, "T1")] == (1.0, 1)


def test_peers_match_missing_departments_and_may_ignore_the_year(spark):
    panel = spark.createDataFrame(PEOPLE, PANEL)
    peers = settle_lookup(el.peer_stats(panel, 55, 10), "peers")
    frame = spark.createDataFrame([(9, 2019, None, "T1")], "EMPLOYEE_ID long, FISCAL_YEAR int, FMS_DEPARTMENT_TITLE string, JOB_CLASS_TITLE string")
    assert el.attach_peers(frame, peers).first()["total_ecount"] is None
    assert el.attach_peers(frame, peers, by_year=False).first()["total_ecount"] == 1


def test_roll_forward(spark):
    frame = spark.createDataFrame(
        [(2018, 60, 20, 4, 5, 0, 100.0, 110.0), (2018, 54, 9, 5, 5, 1, None, None)],
        "FISCAL_YEAR int, age int, service_year int, SALARY_STEP int, HIGHEST_STEP int, whether_highest int, RATE_PP double, RATE_PP_ESTIMATE double",
    )
    one, two = sf.roll_forward(frame).collect()
    assert (one["FISCAL_YEAR"], one["age"], one["service_year"], one["SALARY_STEP"]) == (2019, 61, 21, 5)
    assert (one["dif_step"], one["whether_highest"], one["RATE_PP"]) == (0, 1, 102.0)
    assert (two["SALARY_STEP"], two["dif_step"], two["RATE_PP"]) == (5, 0, None)


def test_score_population_is_last_year_and_not_retired(spark):
    frame = spark.createDataFrame(
        [(1, 2018, 60, 20, 0), (2, 2018, 60, 20, 1), (3, 2017, 60, 20, 0), (4, 2018, 54, 9, 0), (5, 2018, 54, 8, 0), (6, 2018, None, 20, 0)],
        "EMPLOYEE_ID long, FISCAL_YEAR int, age int, service_year int, retire int",
    )
    found = sf.score_population(frame, PolicyConfig())
    assert sorted(r["EMPLOYEE_ID"] for r in found.collect()) == [1, 4]
