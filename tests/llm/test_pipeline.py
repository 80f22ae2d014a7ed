from __future__ import annotations

import random

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.samples import documents, empty

OPERATORS = sorted(k for k in contract.queries() if k.startswith("op"))


def test_every_operator_has_its_query():
    assert [k.split("_")[0] for k in sorted(OPERATORS, key=lambda k: int(k[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(set(OPERATORS) & set(contract.oracle_sql())))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found = contract.queries()[name](spark, SMALL)
    expected = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, expected.fetchall()))


def test_stages_take_effect(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["tha", "wen", "ing", "sho"]) + rng.choice(["ba", "do", "ki"]) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(base)]
    near = base[3].split()
    near[10] = "other"
    rows += [(100, base[2], "en", "s0"), (101, " ".join(near), "en", "s1"), (102, None, "en", "s0"), (103, "12 34", None, "s1")]
    docs = documents(spark, rows, extra=False)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == before.columns
    clean = set(range(12))
    assert seen[0] == clean | {100, 101}
    assert seen[1] == clean | {101} and seen[2] == clean
    assert seen[3] <= clean and seen[4] == seen[3]


def test_without_labels_only_texts_without_letters_go(spark):
    rows = [(1, "a b c", None, "s"), (1, "a b c", None, "s"), (2, None, None, "s"), (3, "12 34 !", None, None), (4, "é", None, "s"), (None, "x", None, "s")]
    docs = documents(spark, rows, extra=False)
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["a b c", "a b c", "x", "é"]


def test_stages_bear_awkward_rows_and_empty_tables(spark):
    for docs in (documents(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs.count()


def test_run_writes_every_stage(spark):
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.count() > 0 and packed.where("offset < 0 or offset + length > 1024").count() == 0
