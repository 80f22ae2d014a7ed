from __future__ import annotations

import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tenurelens.llm import ngram_join
from tenurelens.sources.workspace import run_folder
from tests.llm.samples import documents, empty


def shingles(text, size):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(keys, sets, percent):
    up = list(range(len(keys)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [keys[top(i)] for i in range(len(keys))]


def edited(rng, n):
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(["q", "r", "s"])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("size", "percent", "tokens", "hot"), [(5, 80, 1 << 19, 10**5), (3, 90, 200, 1), (2, 70, 150, 40)])
def test_against_all_pairs(spark, size, percent, tokens, hot):
    texts = edited(random.Random(size * percent), 160)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    settings = ngram_join.Settings(size=size, percent=percent, block_tokens=tokens, cells=64, hot=hot)
    found = ngram_join.link_documents(documents(spark, rows), settings=settings).orderBy("doc_id").collect()
    sets = [shingles(t, size) for t in texts]
    assert [r.n_shingles for r in found] == [len(s) for s in sets]
    assert [r.component_id for r in found] == components(list(range(len(texts))), sets, percent)


def test_trie_finds_all_links():
    rng = np.random.default_rng(0)
    for _ in range(20):
        base = rng.integers(0, 400, rng.integers(1, 150))
        sets = []
        for _ in range(rng.integers(1, 12)):
            x = base.copy()
            k = rng.integers(0, len(x) // 10 + 1)
            x[rng.integers(0, len(x), k)] = rng.integers(0, 3000, k)
            sets.append(np.unique(x))
        sets = list({s.tobytes(): s for s in sets}.values())
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        cuts = np.cumsum([0, *map(len, sets)])
        local = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for step in (1, 4, 32):
            trie, member = ngram_join.Trie(local, None, step), np.zeros(3400, bool)
            for x in local:
                found = sorted(trie.linked(x, len(x), member, 1, 10**9, 80))
                expected = [j for j, y in enumerate(local) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))]
                assert found == expected


def test_awkward_rows(spark):
    found = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.link_documents(documents(spark)).collect()}
    assert found[(1, 3)] == found[(2, 3)] == 1
    assert found[(3, 0)] == 3 and found[(4, 0)] == 4 and found[(7, 0)] == 7
    assert found[(5, 1)] == found[(6, 1)] == 5 and found[(None, 1)] is None and found[(9, 1)] == 9
    assert ngram_join.link_documents(empty(spark)).count() == 0


def test_sketch_counts_every_shingle_and_follows_the_text(spark):
    texts = edited(random.Random(5), 60)
    settings = ngram_join.Settings(size=3, cells=1 << 18)
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).select("text")
    rows = docs.coalesce(1).mapInArrow(ngram_join._sketched(settings), "part int, cells binary, counts binary").collect()
    runs, _ = ngram_join.shingle_runs([t.encode() for t in texts], 3)
    assert sum(np.frombuffer(r.counts, "<u4").sum() for r in rows) == len(runs)
    assert sum(len(r.cells) + len(r.counts) for r in rows) <= 8 * len(runs)
    levels = ngram_join.frequency_levels(docs.repartition(5), settings)
    counts = np.bincount((runs % np.uint64(settings.cells)).astype(np.int64), minlength=settings.cells)
    assert (levels == ngram_join._level(counts).astype(np.uint8)).all()


def test_lots_bound_the_memory_of_a_worker():
    words = np.random.default_rng(5).integers(0, 1 << 30, (4000, 500))
    texts = [" ".join(map(str, row)) for row in words.tolist()]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": texts, "place": list(range(4000))})
    s, levels = ngram_join.Settings(), np.zeros(1 << 22, np.uint8)
    for run in (ngram_join._sketched(s), ngram_join._signed(levels, s), ngram_join._gathered(levels, np.ones(4000, bool), s)):
        list(run(iter([batch.slice(0, 1)])))
        tracemalloc.start()
        try:
            rows = sum(b.num_rows for b in run(iter([batch])))
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert rows and peak < 80_000_000


def test_the_sketch_counts_every_shingle():
    texts = ["a b c d", None, "", "a b c", "x", "a b c d"]
    s = ngram_join.Settings(cells=1 << 18)
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(part, pa.string())}) for part in (texts[:3], texts[3:])]
    found = {
        (part, cell): n
        for b in ngram_join._sketched(s)(iter(batches))
        for part, cells, counts in zip(*(b[c].to_pylist() for c in ("part", "cells", "counts")), strict=True)
        for cell, n in zip(np.frombuffer(cells, "<u4").tolist(), np.frombuffer(counts, "<u4").tolist(), strict=True)
    }
    assert sorted(found.values()) == [1, 2, 3]
    assert {part for part, _ in found} <= set(range(4))


@pytest.mark.parametrize(("few", "percent", "hot"), [(1, 80, 10**5), (3, 70, 10**5), (6, 90, 4), (100, 60, 30)])
def test_pairs_and_groups_of_tokens_find_the_same(spark, few, percent, hot):
    texts = edited(random.Random(few + percent), 120)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    settings = ngram_join.Settings(size=2, percent=percent, block_tokens=200, cells=1 << 16, hot=hot, few=few)
    found = ngram_join.link_documents(documents(spark, rows), settings=settings).orderBy("doc_id").collect()
    assert [r.component_id for r in found] == components(list(range(len(texts))), [shingles(t, 2) for t in texts], percent)


def test_classes_that_meet_by_chance_are_no_group(spark):
    """Every class shares one of its ten prefix tokens with the next; only the last two share enough of them."""
    sets = [[100 * i, *range(100 * i + 10, 100 * i + 18), 100 * (i + 1)] for i in range(30)]
    sets.append([*sets[-1][:9], 9999])
    rows = [(i, 100, [t + 1 for t in tokens]) for i, tokens in enumerate(sets)]
    classes = spark.createDataFrame(rows, "class long, n long, prefix array<long>")
    links = {tuple(sorted(r)) for r in ngram_join._touching(classes, ngram_join.Settings()).collect()}
    assert links == {(29, 30)}


def test_tables_on_the_way_are_removed(spark):
    with run_folder(spark) as folder:
        found = ngram_join.link_documents(documents(spark, [(i, "a b c d e f g", "en", "s") for i in range(9)]))
        assert {r.component_id for r in found.collect()} == {0}
        top = Path(folder.removeprefix("file://"))
        assert {p.name for p in top.glob("*/*")} == {"classes", "sizes", "candidates", "links", "named"}
