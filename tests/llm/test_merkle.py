from __future__ import annotations

import hashlib
import zlib

import pytest

from tenurelens.llm import merkle
from tests.llm.samples import documents, empty


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, index):
    """Root, and per level the place in the run and the run, by plain lists."""
    path = []
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        path.append((index % 8, runs[index // 8]))
        nodes, index = [h("".join(r)) for r in runs], index // 8
    return nodes[0], path


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append(r)
    for some in trees.values():
        some.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    hashes = {t: [leaf(r, r.text) for r in trees[t]] for t in names}
    subroots = [climb(hashes[t], 0)[0] for t in names]
    out = []
    for place, t in enumerate(names):
        root, top = climb(subroots, place)
        for i, r in enumerate(trees[t]):
            subroot, path = climb(hashes[t], i)
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            at = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)) if tampered else hashes[t][i]
            proof = ""
            for own, run in path + top:
                proof += "".join(run[:own] + run[own + 1 :])
                at = h("".join([*run[:own], at, *run[own + 1 :]]))
            out.append((r.doc_id, hashes[t][i], subroot, root, h(proof), at, at == root))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 57, 64, 65, 513])
def test_positions_are_those_of_the_log(n):
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
    levels = merkle.height(n)
    log = merkle.postorder(leaves, levels)
    nodes, seen = [d.hex() for d in leaves], set()
    for level in range(levels + 1):
        for index, digest in enumerate(nodes):
            at = merkle.position(level, index, n)
            assert log[at * 32 : at * 32 + 32].hex() == digest
            seen.add(at)
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    assert seen == set(range(len(log) // 32))
    for i in {0, n // 2, n - 1}:
        path = merkle.local_path(log, i, n, levels)
        assert merkle.folded(path, leaves[i]) == log[-32:]
        assert (merkle.folded(path, b"x" * 32) == log[-32:]) is (n == 0)


def test_trees_of_many_sizes(spark):
    """More leaves than a block, trees of one leaf, more trees than a run, repeated and missing keys."""
    rows = [(i % 1500, f"Text {i} É", "en", "s") for i in range(1700)] + [(i, "Aa" * i, f"l{i % 11}", None) for i in range(120)]
    rows += [(None, "Zz", None, "s"), (None, "Zz", None, "s"), (3, None, None, None), (5, "", "", ""), (6, "X" * 100_000, "ÿ", "s")]
    docs = documents(spark, rows).repartition(3)
    assert found(merkle.checked(docs, merkle.tampered_text())) == brute(docs.collect())


def test_awkward_rows(spark):
    docs = documents(spark)
    assert found(merkle.checked(docs, merkle.tampered_text())) == brute(docs.collect())
    assert merkle.checked(empty(spark), merkle.tampered_text()).count() == 0
    assert merkle.build(merkle.leaves(empty(spark))).root is None


def test_untouched_rows_are_verified_and_any_field_counts(spark):
    docs = documents(spark, [(i, f"t{i}", "en", "s") for i in range(30)], extra=False)
    assert merkle.checked(docs).where("not verified").count() == 0
    other = merkle.build(merkle.leaves(docs.selectExpr("doc_id", "text", "lang", "if(doc_id = 7, 'S', source) as source", "n_chars")))
    assert other.root != merkle.build(merkle.leaves(docs)).root


def test_repeated_rows_of_one_key_are_spread(spark):
    rows = spark.range(4000).selectExpr("'=en' as tree", "1L as key", "unhex(sha2('x', 256)) as leaf", "cast(null as binary) as changed")
    out = merkle.placed(rows.repartition(4), ["key", "leaf", "changed"])
    assert sorted(r.place for r in out.select("place").collect()) == list(range(4000))
    assert {r.total for r in out.select("total").distinct().collect()} == {4000}
