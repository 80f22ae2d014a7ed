"""A corpus prepared in stages, and every query of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenurelens.llm import language_id, line_dedup, mixing, ngram_join, packing, registry
from tenurelens.llm.rows import numbered
from tenurelens.sources.workspace import settle, settle_alone

#: Near duplicates share this part of their shingles of five words.
NEAR = ngram_join.Settings(size=5, percent=80)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; NULL texts and texts without a letter go, and only these where no label is there to learn from."""
    network = language_id.fit(docs)
    if network is None:
        return language_id.with_letters(docs)
    found = language_id.predict(docs, network, names=("__language", "__score"))
    return found.where(F.col("__language") != language_id.UNKNOWN).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are deleted; documents that lose all lines go."""
    found = line_dedup.dedup_lines(numbered(docs), names=("__lines", "__deleted"))
    kept = found.where((F.col("__deleted") == 0) | (F.col("__deleted") < F.col("__lines")))
    length = F.when(F.col("__deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", length).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, also by way of others, the document with the least doc_id stays; of equal ids the first row."""
    rows = numbered(docs)

    def grouped() -> DataFrame:
        linked = ngram_join.link_documents(rows, key="__row", settings=NEAR).select("__row", F.col("component_id").alias("__group"))
        return rows.select("__row", "doc_id").join(linked, "__row")

    ids = settle_alone(spark, "groups", grouped)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")
    first = ids.groupBy("__group").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = ids.join(first, "__group").where(F.col("__row") != F.col("first.__row")).select("__row")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece of every document, copies included, with its place in a sequence."""
    return packing.digest(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries():
    return registry.QUERIES | {"pipeline": run}


def oracle_sql():
    return registry.ORACLES | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
