"""Character hashing and stable buckets."""

from hashlib import md5

import pytest

from tenurelens.functions.hashing import char_hash, key_bucket
from tenurelens.operators.encode import HASHED_COLUMNS


def expected(text, buckets):
    out = [0] * buckets
    for c in text or "":
        h = int(md5(c.encode()).hexdigest()[:8], 16)
        out[h % buckets] += 1 if (h >> 10) % 2 == 0 else -1
    return out


@pytest.mark.parametrize("text", ["", None, "a", "aaa", "POLICE OFFICER II", "N/A", "Señor Ünïcode 😀", "12"])
@pytest.mark.parametrize("buckets", [2, 3])
def test_signed_counts(spark, text, buckets):
    df = spark.createDataFrame([(text,)], "x string")
    assert list(df.select(*char_hash("x", buckets, "h")).first()) == expected(text, buckets)


def test_columns(spark):
    assert len(HASHED_COLUMNS) == 26
    df = spark.createDataFrame([("a",)], "x string").select(*char_hash("x", 3, "job"))
    assert df.dtypes == [("job_0", "int"), ("job_1", "int"), ("job_2", "int")]


def test_buckets_ignore_partitioning(spark):
    df = spark.range(2000).selectExpr("id", "2018 as fy")
    one = dict(df.repartition(1).select("id", key_bucket(100, 82, "id", "fy")).collect())
    many = dict(df.repartition(13).select("id", key_bucket(100, 82, "id", "fy")).collect())
    assert one == many
    share = sum(b < 80 for b in one.values()) / len(one)
    assert 0.76 < share < 0.84
    assert one != dict(df.select("id", key_bucket(100, 83, "id", "fy")).collect())
