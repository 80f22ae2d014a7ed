"""Text input rules, sinks and the shared folder."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, IntegerType, StringType

from tenurelens.sources import io, workspace
from tenurelens.sources.schema import JOB_STEPS, SCORE_FRAME, TRAIN_FRAME

SCHEMA = StructType([StructField("s", StringType()), StructField("n", IntegerType())])


def test_blank_and_missing_text(spark, tmp_path):
    (tmp_path / "in.csv").write_text('s,n\n,1\n"",2\n" ",3\nNA,4\nN/A,5\nx,\ny,NA\n')
    found = [tuple(r) for r in io.read_csv(spark, str(tmp_path / "in.csv"), SCHEMA).collect()]
    assert found == [("", 1), ("", 2), (" ", 3), (None, 4), ("N/A", 5), ("x", None), ("y", None)]


def test_malformed_numbers_fail(spark, tmp_path):
    (tmp_path / "in.csv").write_text("s,n\nx,12a\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        io.read_csv(spark, str(tmp_path / "in.csv"), SCHEMA).collect()


def test_csv_round_trip(spark, tmp_path, rows):
    data = [("10", "CLERK", " ", 5), ("", 'say "hi", you', "N/A", None), (None, "é", "0", 7)]
    df = spark.createDataFrame(data, JOB_STEPS)
    io.write_csv(df, str(tmp_path / "out"))
    assert rows(io.read_csv(spark, str(tmp_path / "out"), JOB_STEPS)) == rows(df)


def test_parquet_round_trip_by_year(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, None)], SCHEMA)
    io.write_parquet(df, str(tmp_path / "out"), partition_by=["n"])
    found = io.read_parquet(spark, str(tmp_path / "out"), SCHEMA)
    assert rows(found) == rows(df)
    plan = found.filter("n = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(n" in plan


def test_settled_table_ends_the_lineage(spark, rows):
    df = spark.range(10).selectExpr("id", "id * 2 as twice")
    table = workspace.settle(df, "numbers")
    assert rows(table) == rows(df)
    assert table.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(workspace.shared_folder(spark).lstrip("/"))
    assert "Range" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_settling_no_rows_keeps_the_columns(spark):
    empty = workspace.settle(spark.range(0).selectExpr("id", "'x' as s"), "empty")
    assert empty.dtypes == [("id", "bigint"), ("s", "string")] and empty.count() == 0


class OnCluster:
    class conf:
        get = staticmethod(lambda name, default: default)

    class sparkContext:
        master = "yarn"


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_folder(OnCluster)


def test_columns_are_read_by_name(spark, tmp_path):
    from pyspark.sql import types as T

    from tenurelens.sources import io

    (tmp_path / "x.csv").write_text('more,TITLE,N\n1,"CLERK ""A"" TYPIST",7\n2,NA,NaN\n')
    fields = T.StructType([T.StructField("N", T.DoubleType()), T.StructField("TITLE", T.StringType())])
    found = io.read_csv(spark, str(tmp_path / "x.csv"), fields)
    assert found.columns == ["N", "TITLE"]
    assert [tuple(r) for r in io.clean_numbers(found).collect()] == [(7.0, 'CLERK "A" TYPIST'), (None, None)]
    with pytest.raises(ValueError, match="no column"):
        io.read_csv(spark, str(tmp_path / "x.csv"), fields.add("MISSING", "string"))
    infinite = spark.createDataFrame([(float("inf"),)], "HW_TYPE_PAY double")
    with pytest.raises(Exception, match="HW_TYPE_PAY is infinite"):
        io.clean_numbers(infinite).collect()


def test_records_that_do_not_parse_are_set_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text('s,n,x\nok,1,0\n"two\nlines",2,0\nshort,3\nlong,4,0,0\nno number,5b,0\ndecimal,6.0,0\nhalf,6.5,0\nlarge,99999999999,0\n,NA,0\n')
    (tmp_path / "b.csv").write_text("s,n,x\nother, 8 ,0\n")
    found = io.parse_csv(spark, str(tmp_path), SCHEMA, multi_line=True)
    assert sorted(map(tuple, found.rows.collect()), key=repr) == sorted([("ok", 1), ("two\nlines", 2), ("decimal", 6), ("", None), ("other", 8)], key=repr)
    rejected = {(r["record"], r["reason"], r["file"].rsplit("/", 1)[-1]) for r in found.rejected.collect()}
    assert rejected == {
        ("short,3", "wrong number of fields", "a.csv"),
        ("long,4,0,0", "wrong number of fields", "a.csv"),
        ("no number,5b,0", "n is no int", "a.csv"),
        ("half,6.5,0", "n is no int", "a.csv"),
        ("large,99999999999,0", "n is no int", "a.csv"),
    }
    # whatever is read of the rows, the records set apart are the same
    assert found.rows.select("s").count() == 5 and found.rejected.select("reason").count() == 5
    with pytest.raises(ValueError, match="no column"):
        io.parse_csv(spark, str(tmp_path), StructType([StructField("gone", StringType())]))


def test_frames_have_the_schema_of_the_queries(spark):
    from checks import queries as q
    from tests.conftest import SMALL

    for query, fields in ((q.train_frame, TRAIN_FRAME), (q.score_frame, SCORE_FRAME)):
        assert {f.name: f.dataType for f in query(spark, SMALL).schema.fields} == {f.name: f.dataType for f in fields.fields}


def test_a_write_that_fails_leaves_the_old_result(spark, tmp_path, rows):
    path = str(tmp_path / "out")
    io.write_parquet(spark.range(3), path)
    broken = spark.range(0, 8, 1, 4).selectExpr("if(id = 5, raise_error('no'), id) as id")
    for write in (io.write_parquet, io.write_csv):
        with pytest.raises(Exception, match="no"):
            write(broken, path)
        assert rows(spark.read.parquet(path)) == [(0,), (1,), (2,)]
    io.write_parquet(spark.range(2), path)
    assert rows(spark.read.parquet(path)) == [(0,), (1,)]
    # neither halves nor old results stay beside it
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_files_of_a_key_are_bounded(spark, tmp_path, rows):
    df = spark.range(0, 6000, 1, 12).selectExpr("id", "if(id % 3 = 0, 2018, 2000 + id % 7) as year")
    # as if there were too many rows to be written by one task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_parquet(df, str(tmp_path / "out"), partition_by=["year"], files_per_key=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [len(list(p.glob("part-*"))) for p in (tmp_path / "out").glob("year=*")]
    assert len(files) == 8 and max(files) <= 3
    # the year with a third of the rows is written by several tasks
    assert len(list((tmp_path / "out" / "year=2018").glob("part-*"))) > 1
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id", "year")) == rows(df)


def test_a_run_removes_its_tables(spark):
    from pathlib import Path

    with pytest.raises(RuntimeError), workspace.run_folder(spark) as folder:
        table = workspace.settle(spark.range(5), "numbers")
        assert table.count() == 5 and Path(folder.removeprefix("file:")).is_dir()
        raise RuntimeError
    assert not Path(folder.removeprefix("file:")).exists()
    assert workspace.settle(spark.range(5), "numbers").count() == 5


def test_csv_files_are_bounded_and_read_side_by_side(spark, tmp_path, rows):
    """A file with line breaks in its fields is one task's, so the writer makes several of many rows."""
    table = spark.createDataFrame([(i, f"a{chr(10)}{i}") for i in range(10)], "n int, t string").coalesce(1)
    io.write_csv(table, f"{tmp_path}/t", records_per_file=4)
    assert len(list((tmp_path / "t").glob("*.csv"))) == 3
    parsed = io.parse_csv(spark, f"{tmp_path}/t", table.schema, multi_line=True)
    assert rows(parsed.rows) == rows(table) and parsed.rejected.count() == 0
    assert parsed.rows.select(F.input_file_name()).distinct().count() == 3


def test_a_written_table_leaves_no_shuffle_files(spark):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = {int(x) for x in tracker.shuffleStatuses().keys().mkString(",").split(",") if x}
    set_to = spark.conf.get(workspace.CLEANUP)
    shuffled = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().orderBy("k")
    table = workspace.settle(shuffled, "counts")
    after = {int(x) for x in tracker.shuffleStatuses().keys().mkString(",").split(",") if x}
    assert after <= before and spark.conf.get(workspace.CLEANUP) == set_to
    assert table.count() == shuffled.count() == 7


def test_tables_on_the_way_to_a_table_are_removed(spark):
    paths = []

    def make():
        table = workspace.settle(spark.range(5), "on-the-way")
        paths.append(table.inputFiles()[0].split(":", 1)[1])
        return table.where("id > 2")

    with workspace.run_folder(spark):
        kept = workspace.settle_alone(spark, "kept", make)
        assert kept.count() == 2 and not Path("/" + paths[0].lstrip("/")).exists()
        assert workspace.settle(spark.range(3), "later").count() == 3
