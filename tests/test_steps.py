"""Step ceilings over their whole small domain."""

from itertools import product


from tenurelens.operators import steps
from tenurelens.sources.workspace import settle_lookup


def repaired(highest, step):
    """The updates one after another, on headroom that stays as it was."""
    stale = highest - step
    rules = [
        (lambda h: h == 12, 15),
        (lambda h: h == 0 and step <= 5, 5),
        (lambda h: h == 0 and step == 6, 6),
        (lambda h: h == 0 and step <= 8, 8),
        (lambda h: h == 0 and step <= 12, 12),
        (lambda h: h == 2, 6),
        (lambda h: h == 6, 8),
    ]
    for rule, value in rules:
        if stale < 0 and rule(highest):
            highest = value
    return highest


def test_repair_equals_the_ordered_updates(spark):
    pairs = list(product(range(20), range(20)))
    df = spark.createDataFrame(pairs, "HIGHEST_STEP int, SALARY_STEP int")
    found = df.select("HIGHEST_STEP", "SALARY_STEP", steps.step_repair().alias("h")).collect()
    assert len(found) == 400
    assert all(r["h"] == repaired(r["HIGHEST_STEP"], r["SALARY_STEP"]) for r in found)


def test_defaults_only_fill_missing_steps(spark):
    data = [(None, 3766), (None, 1790), (None, 7294), (None, 1576), (None, 1), (None, None), (9, 3766)]
    df = spark.createDataFrame(data, "HIGHEST_STEP int, JOB_CLASS int")
    assert [r[0] for r in df.select(steps.step_default()).collect()] == [0, 15, 5, 11, 12, 12, 9]


def test_negative_headroom_is_not_highest(spark):
    df = spark.createDataFrame([(5, 5), (5, 4), (5, 6)], "HIGHEST_STEP int, SALARY_STEP int")
    found = steps.with_headroom(df).select("dif_step", "whether_highest").collect()
    assert [tuple(r) for r in found] == [(0, 1), (1, 0), (-1, 0)]


def test_step_table_and_join(spark, rows):
    table = spark.createDataFrame(
        [
            ("10", "CLERK", "0", 5),
            ("10", "CLERK", "0", 5),
            ("x", "CLERK", "0", 6),
            ("11", "CLERK", "1", None),
            ("12", "MACHINIST SUPERVISOR", "0", 7),
            ("12", "MACHINIST SUPERVISOR", "1", 8),
            ("13", "MUNICIPAL POLICE OFFICER III", "1", 9),
            ("14", None, "1", 9),
        ],
        "JOB string, JOB_CLASS_TITLE string, PAY_GRADE string, HIGHEST_STEP int",
    )
    usable = steps.step_table(table)
    assert rows(usable) == sorted(
        [(10, "CLERK", "0", 5), (None, "CLERK", "0", 6), (12, "MACHINIST SUPERVISOR", "1", 8)], key=repr
    )
    panel = spark.createDataFrame(
        [(1, 10, "CLERK", "0"), (2, None, "CLERK", "0"), (3, 99, "CLERK", "0")],
        "EMPLOYEE_ID long, JOB_CLASS int, JOB_CLASS_TITLE string, PAY_GRADE string",
    )
    joined = steps.attach_steps(panel, settle_lookup(usable, "steps"))
    assert dict(joined.select("EMPLOYEE_ID", "HIGHEST_STEP").collect()) == {1: 5, 2: 6, 3: None}


def test_whole_step_operator(spark):
    panel = spark.createDataFrame(
        [(1, 10, "CLERK", "0", 7)],
        "EMPLOYEE_ID long, JOB_CLASS int, JOB_CLASS_TITLE string, PAY_GRADE string, SALARY_STEP int",
    )
    table = spark.createDataFrame([("10", "CLERK", "0", 6)], "JOB string, JOB_CLASS_TITLE string, PAY_GRADE string, HIGHEST_STEP int")
    row = steps.with_steps(panel, settle_lookup(steps.step_table(table), "steps")).first()
    assert (row["HIGHEST_STEP"], row["dif_step"], row["whether_highest"]) == (8, 1, 0)
    assert row["EMPLOYEE_ID"] == 1
