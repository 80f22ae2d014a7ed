"""Category clean-up and target means."""

import pytest
from pyspark.sql import functions as F

from tenurelens.operators import encode
from tenurelens.operators.encode import TARGET_MEANS, TargetMeans

COLUMNS = (
    "EMPLOYEE_ID long, WORK_SCHEDULE string, RETIREMENT_PENSION_PLAN string, ETHNICITY string, GENDER string, "
    "MARITAL_STATUS string, MOU int, HIGHEST_STEP int, FMS_DEPARTMENT_TITLE string, JOB_CLASS_TITLE string, "
    "SALARY_STEP int, retire int"
)
FIT = [
    (1, "A", "P", "E", "F", "S", 1, 5, "D1", "T1", 1, 1),
    (2, "A", "P", "E", "M", "S", None, 5, "D1", "T1", 2, 0),
    (3, "B", "P", "E", "M", "S", None, 6, "D1", "T2", 1, 1),
    (4, "B", "P", "E", "M", "S", 1, None, None, "T1", 1, 0),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(FIT, COLUMNS)


@pytest.fixture(scope="module")
def means(frame):
    return TargetMeans.fit(frame)


def test_normalise(spark, rows):
    data = [("N/A", "", ""), (" ", "Unknown", "Single"), ("Variable", "E", " "), ("  ", " ", None), (None, None, "x")]
    df = spark.createDataFrame(data, "WORK_SCHEDULE string, ETHNICITY string, MARITAL_STATUS string")
    assert [tuple(r) for r in encode.normalise(df).collect()] == [
        ("Other", "Other", "Unknown"),
        ("Other", "Other", "Single"),
        ("Other", "E", " "),
        ("  ", " ", None),
        (None, None, "x"),
    ]


def test_one_pass_equals_one_aggregation_per_key(frame, means, rows):
    for name, keys in TARGET_MEANS.items():
        assert rows(means.means(name)) == rows(encode.target_mean(frame, keys, name))
        assert means.rows[name] == means.means(name).count()


def test_applied_to_its_own_rows_it_is_the_group_mean(frame, means):
    found = means.apply(frame)
    assert found.count() == frame.count()
    for name, keys in TARGET_MEANS.items():
        expected = {
            r["EMPLOYEE_ID"]: sum(x[-1] for x in FIT if _key(x, keys) == _key(tuple(r)[: len(FIT[0])], keys))
            / sum(1 for x in FIT if _key(x, keys) == _key(tuple(r)[: len(FIT[0])], keys))
            for r in found.collect()
        }
        assert {r["EMPLOYEE_ID"]: r[name] for r in found.collect()} == expected


def _key(row, keys):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return tuple(row[names.index(k)] for k in keys)


def test_unseen_job_falls_back_and_unseen_step_is_dropped(spark, means):
    new = spark.createDataFrame(
        [
            (7, "Z", "P", "E", "F", "S", None, 5, "D9", "T9", 1, 0),
            (8, "A", "P", "E", "F", "S", 2, 5, "D1", "T1", 9, 0),
            (9, "A", "P", "E", "F", "S", 2, None, None, "T1", 1, 0),
        ],
        COLUMNS,
    )
    found = {r["EMPLOYEE_ID"]: r for r in means.apply_unseen(new).collect()}
    assert set(found) == {7, 9}
    # unweighted over (D1, T1), (D1, T2), (NULL, T1)
    assert found[7]["jclass_persent"] == 0.5
    assert found[7]["WORK_SCHEDULE_persent"] is None
    assert found[7]["MOU_persent"] == 0.5
    assert found[9]["jclass_persent"] == 0.0 and found[9]["CSTEP_persent"] == 0.0
    assert found[9]["MOU_persent"] is None


def test_fit_on_some_rows(frame):
    means = TargetMeans.fit(frame.filter(F.col("EMPLOYEE_ID") < 3))
    found = {r["EMPLOYEE_ID"]: r["GENDER_persent"] for r in means.apply(frame).collect()}
    assert found == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_hash_encode_uses_the_digits_of_mou(frame):
    frame = frame.withColumn("PAY_GRADE", F.lit("0"))
    encoded = encode.hash_encode(frame)
    assert encoded.columns == frame.columns + encode.HASHED_COLUMNS
    one = encoded.filter("EMPLOYEE_ID = 2").first()
    assert (one["mou_0"], one["mou_1"], one["mou_2"]) == (0, 0, 0)


def test_a_dictionary_gives_the_same_hashes(spark, rows):
    texts = ["FIRE", "", None, "Ärger", "a" * 300, " FIRE"]
    data = [(i, *(texts[(i + k) % 6] for k in range(7)), f"title {i}", None if i % 5 == 0 else i % 9 - 4) for i in range(90)]
    columns = [c for c in encode.HASHED if c not in ("JOB_CLASS_TITLE", "MOU")]
    frame = spark.createDataFrame(data, ["EMPLOYEE_ID", *columns, "JOB_CLASS_TITLE", "MOU"])
    dictionary = encode.TextDictionary.of(frame)
    # titles are all distinct, so they are hashed row by row
    assert [c for c in encode.HASHED if not dictionary.worthwhile(c)] == ["JOB_CLASS_TITLE"]
    plain, looked_up = encode.hash_encode(frame), encode.hash_encode(frame, dictionary)
    assert looked_up.columns == plain.columns and rows(looked_up) == rows(plain)
    assert encode.hash_encode(frame.limit(0), encode.TextDictionary.of(frame.limit(0))).count() == 0
