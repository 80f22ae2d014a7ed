from __future__ import annotations

import itertools
import json
import tracemalloc
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tenurelens.llm import packing
from tenurelens.llm.encoder import Encoder
from tests.llm.samples import documents, empty

FILE = public_tokenizers.path("byte_bpe_50k.json")


def least_bins(sizes, capacity):
    """By trying all ways, for few pieces."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[k] >= sizes[i]:
                go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bounds_and_packings(sizes):
    lengths = np.array(sizes, dtype=np.int64)
    bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)
    assert bound <= least_bins(sorted(sizes, reverse=True), 20)
    for pack in (packing.best_fit_decreasing, packing.best_filling):
        bins, offsets, fill = pack(lengths, 20)
        assert len(fill) >= bound and (fill <= 20).all()
        for b in range(len(fill)):
            inside = np.flatnonzero(bins == b)
            inside = inside[np.argsort(offsets[inside])]
            assert offsets[inside].tolist() == [0, *itertools.accumulate(lengths[inside].tolist())][:-1]
            assert fill[b] == lengths[inside].sum()


def test_exchange_between_partitions_saves_sequences(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(150, 700, 600))]
    pieces = spark.createDataFrame(rows, "key long, length long")
    apart = packing._dealt(pieces, 600, 0, 1024, 20)
    together = packing.pack(pieces, partition_pieces=20)
    assert together.select("key").distinct().count() == 600
    assert together.select("sequence_id").distinct().count() < packing._bins(apart)


def test_full_partitions_exchange_too_while_the_whole_is_above_its_bound(spark):
    keys = spark.range(200).selectExpr("id", *(f"pmod(xxhash64(id, {turn}), 2L) as p{turn}" for turn in (0, 1)))
    at = {(r.p0, r.p1): r.id for r in keys.collect()}
    # dealt as {600, 400} and {624, 424}, then as {600, 424} and {624, 400}
    rows = [(at[0, 0], 600), (at[0, 1], 400), (at[1, 1], 624), (at[1, 0], 424)]
    pieces = spark.createDataFrame(rows, "key long, length long")
    assert packing._bins(packing._dealt(pieces, 4, 0, 1024, 2)) == 3
    packed = packing.pack(pieces, partition_pieces=2).collect()
    assert len({r.sequence_id for r in packed}) == 2 and {(r.key, r.length) for r in packed} == set(rows)


def test_awkward_rows_round_trip(spark):
    docs = documents(spark)
    packed = packing.pack_documents(docs, FILE)
    found = packing.digest(packed).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for places in seqs.values():
        places.sort()
        assert [p for p, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1]
        assert sum(n for _, n in places) <= 1024
    tokenizer = Tokenizer.from_file(FILE)
    for d in docs.where("doc_id is null or doc_id <> 6").collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted(pieces[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert len(pieces[6]) == 2
    assert packing.pack_documents(empty(spark), FILE).count() == 0


def test_numbers_of_late_rounds_stay_apart(spark):
    """A round takes only the numbers its parts need, so that there is no last round."""
    base = 1 << 62
    rows = packing._dealt(spark.range(40).selectExpr("id as key", "600L as length"), 40, 1000, 1024, 8, base).collect()
    assert len({r.sequence_id for r in rows}) == 40
    assert all(base <= r.sequence_id < base + packing._parts(40, 8) * packing._PART for r in rows)


def test_lots_bound_the_memory_of_a_worker():
    texts = [" ".join(f"w{(i * 7 + j * 31) % 5000}" for j in range(400)) for i in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1500)), "text": texts})
    run = packing._pieces(FILE, packing.END_ID, packing.CAPACITY)
    list(run(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found >= 1500 and peak < 60_000_000


def test_words_are_encoded_side_by_side_with_the_ids_of_whole_texts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, given_texts = Encoder(path), []
    once = encode._encode
    monkeypatch.setattr(encode, "_encode", lambda texts, *n: given_texts.extend(texts) or once(texts, *n))
    texts = [" ".join(f"don't{i}x{k}, été-{i * k}" for k in range(60)) + "\nnext 'line' ’tis" for i in range(20)]
    plain = Tokenizer.from_file(path)
    assert [ids.tolist() for ids in encode(texts, 2)] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    words = len({w for t in texts for w in t.split()})
    assert words > 1_000 and len(given_texts) < words / 10


def test_a_file_that_cuts_texts_gets_its_words_one_by_one(tmp_path):
    path = tmp_path / "cuts.json"
    spec = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8"))
    spec["truncation"] = {"direction": "Right", "max_length": 40, "strategy": "LongestFirst", "stride": 0}
    path.write_text(json.dumps(spec), encoding="utf-8")
    encode = Encoder(str(path))
    words = [f" word{i}" for i in range(120)]
    ids, start, length = encode._encode_words(words, np.ones(len(words), bool))
    assert encode.opens is None
    assert [ids[a : a + n].tolist() for a, n in zip(start, length)] == [encode.tokenizer.encode(w).ids for w in words]
