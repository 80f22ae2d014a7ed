from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tenurelens.llm import token_index
from tenurelens.sources.workspace import scratch_path
from tests.llm.samples import documents, empty

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_perfect_hash_is_minimal_and_tells_strangers_apart():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    index = token_index.Index(token_index.index_bytes(keys.tolist(), [3] * len(keys), 2))
    first, number = index.find(keys)
    assert first.tolist() == list(range(len(keys))) and (number == 1).all()
    assert index.bits.sum() == len(keys)
    assert index.find(keys + 1)[1].sum() <= 1


def test_round_trip_of_awkward_rows(spark):
    docs = documents(spark)
    found = token_index.round_trip(spark, docs, FILE).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(FILE)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for r, d in zip(found, rows, strict=True):
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens) == (d.doc_id, at, len(ids))
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert token_index.round_trip(spark, empty(spark), FILE).count() == 0


def test_lookup_of_some_keys(spark):
    folder = scratch_path(spark, "shards")
    manifest = token_index.write_shards(documents(spark), folder, FILE)
    keys = spark.createDataFrame([(5,), (6,), (99,), (-4,)], "k long")
    found = token_index.lookup(keys, folder, manifest).collect()
    assert sorted(r.doc_id for r in found) == [5, 6, 6]
