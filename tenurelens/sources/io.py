"""Readers and writers for the payroll tables and the finished frames."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from tenurelens.sources.workspace import remove, replace_folder

MISSING_TEXT = "NA"
#: Column of whole records that have not as many fields as the header.
BROKEN = "__broken"


def _from_text(field: T.StructField) -> Column:
    """``NA`` is missing everywhere; a blank is missing only in number columns."""
    raw = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.when(F.coalesce(raw, F.lit("")) != MISSING_TEXT, F.coalesce(raw, F.lit(""))).alias(field.name)
    blank = raw.isNull() | F.trim(raw).isin("", MISSING_TEXT)
    return F.when(~blank, raw.cast(field.dataType)).alias(field.name)


def _raw(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    """All fields as text, and the whole record in ``BROKEN`` where it hasn't as many fields as the header."""
    names = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line).columns
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    fields = T.StructType([T.StructField(c, T.StringType()) for c in (*names, BROKEN)])
    # with pruned columns the fields of a record aren't counted
    reader = spark.read.schema(fields).option("columnPruning", False)
    return reader.csv(path, header=True, quote='"', escape='"', multiLine=multi_line, columnNameOfCorruptRecord=BROKEN)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Delimited text with a header; the columns of ``schema`` by name, in any order among others.

    Fields are read as text and typed afterwards, so blank text stays a
    category and only ``NA`` becomes NULL; a malformed number fails the job, and
    so does a missing column. A quote within quotes is doubled. With ``multi_line`` a quoted field may
    hold line breaks; a file is then read by one task.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select(*[_from_text(f) for f in schema.fields])


@dataclass(frozen=True)
class Parsed:
    """Typed rows of the records that parse, and the others: file, record, reason."""

    rows: DataFrame
    rejected: DataFrame


def _tried(field: T.StructField) -> Column:
    """The typed value, NULL where the text is none. Whole numbers may be written with a decimal point."""
    raw = F.trim(F.col(f"`{field.name}`"))
    if isinstance(field.dataType, T.StringType):
        return _from_text(field)
    if isinstance(field.dataType, (T.IntegerType, T.LongType)):
        number = raw.try_cast("double")
        whole = F.when(number == F.floor(number), raw.try_cast("decimal(38,10)")).try_cast(field.dataType)
        return F.coalesce(raw.try_cast(field.dataType), whole)
    return raw.try_cast(field.dataType)


def _malformed(field: T.StructField) -> Column:
    raw = F.col(f"`{field.name}`")
    given = raw.isNotNull() & ~F.trim(raw).isin("", MISSING_TEXT)
    return F.when(given & _tried(field).isNull(), F.lit(f"{field.name} is no {field.dataType.simpleString()}"))


def parse_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> Parsed:
    """Like ``read_csv``, but a record with a wrong number of fields or a malformed value is set
    apart, with its file and all reasons, and does not stop the others. Every record is in one of the two."""
    raw = _raw(spark, path, schema, multi_line)
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    reasons = F.concat_ws("; ", F.when(F.col(BROKEN).isNotNull(), F.lit("wrong number of fields")), *[F.when(F.col(BROKEN).isNull(), _malformed(f)) for f in typed])
    record = F.coalesce(F.col(BROKEN), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in raw.columns if c != BROKEN])))
    judged = raw.withColumn("__reason", reasons)
    rejected = judged.where(F.col("__reason") != "").select(F.col("_metadata.file_path").alias("file"), record.alias("record"), F.col("__reason").alias("reason"))
    return Parsed(judged.where(F.col("__reason") == "").select(*[_value(f) for f in schema.fields]), rejected)


def _value(field: T.StructField) -> Column:
    return _tried(field).alias(field.name)


def _number(field: T.StructField) -> Column:
    """NaN is missing; an infinite number is refused."""
    value = F.col(f"`{field.name}`").cast(field.dataType)
    if not isinstance(field.dataType, T.DoubleType):
        return value
    refused = F.raise_error(F.lit(f"{field.name} is infinite")).cast("double")
    return F.when(F.abs(value) == float("inf"), refused).when(~F.isnan(value), value)


def clean_numbers(df: DataFrame) -> DataFrame:
    return df.select(*[_number(f).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    found = spark.read.parquet(path)
    return found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


#: Files of a partition key, at most.
FILES_PER_KEY = 8
#: Records of a CSV file, at most: one with line breaks in its fields is read by one task.
RECORDS_PER_FILE = 500_000


def _publish(df: DataFrame, path: str, write: Callable[[DataFrameWriter, str], None]) -> None:
    """Writes beside ``path`` and then takes its place: a write that fails leaves the old result as it was.

    On a store without renames the old result is missing for the time that copying takes.
    """
    spark, part = df.sparkSession, f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    try:
        write(df.write, part)
        replace_folder(spark, part, path)
    finally:
        remove(spark, part)


def write_csv(df: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Header, ``NA`` for missing, quoted blanks, no index column; files of ``records_per_file`` records at most,
    so that their number grows with the rows and reading them again, line breaks or not, is spread over tasks."""

    def write(writer: DataFrameWriter, part: str) -> None:
        writer.option("maxRecordsPerFile", records_per_file).csv(
            part,
            header=True,
            nullValue=MISSING_TEXT,
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )

    _publish(df, path, write)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, files_per_key: int = FILES_PER_KEY) -> None:
    """With ``partition_by``, the rows of a key are brought together in ``files_per_key`` files at most, dealt by
    a hash of the row, so that a key with many rows is written by several tasks."""
    if not partition_by:
        _publish(df, path, lambda writer, part: writer.parquet(part))
        return
    others = [F.col(f"`{c}`") for c in df.columns if c not in partition_by]
    share = F.pmod(F.xxhash64(*others), F.lit(files_per_key)) if others else F.lit(0)
    clustered = df.withColumn("__share", share).repartition(*partition_by, "__share").drop("__share")
    _publish(clustered, path, lambda writer, part: writer.partitionBy(*partition_by).parquet(part))


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as a result and read back, so that what follows starts from the result."""
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
