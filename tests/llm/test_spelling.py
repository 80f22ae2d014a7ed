from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from tenurelens.llm import spelling
from tenurelens.llm.acceptor import Register
from tests.llm.samples import documents, empty


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, shortest=7, least=2):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def brute(words, ratio=10):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


def found(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def vocabulary(seed, size, letters="abé", lengths=(7, 9)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))): rng.choice([2, 3, 25, 400, 5000]) for _ in range(size)}


def test_acceptor_is_minimal_and_numbers_its_words():
    words = sorted(vocabulary(1, 500, lengths=(0, 9)))
    register = Register()
    start = register.acceptor(words)
    for place, word in enumerate(words):
        q, at = start, 0
        for c in word:
            q, before = register.arcs[q][c]
            at += before
        assert register.final[q] and at == place
    assert register.size[start] == len(words)
    endings = {frozenset(w[i:] for w in words if w.startswith(p)) for v in words for i in range(len(v) + 1) for p in [v[:i]]}
    assert len(register.arcs) == len(endings)


def test_composition_gives_every_pair_once():
    short, long = sorted(vocabulary(2, 300, lengths=(6, 6))), sorted(vocabulary(3, 300, lengths=(7, 7)))
    register = Register()
    a, b = register.acceptor(short), register.acceptor(long)
    pairs = list(register.replaced(a))
    assert sorted(pairs) == [(i, j) for i, j in combinations(range(len(short)), 2) if one_edit(short[i], short[j])]
    pairs = list(register.inserted(a, b, at_end=True))
    assert sorted(pairs) == [(i, j) for i in range(len(short)) for j in range(len(long)) if one_edit(short[i], long[j])]


@pytest.mark.parametrize("most", [4096, 40, 3])
def test_near_pairs_against_all_pairs(spark, most):
    """Also where windows have to be halved down to one letter."""
    words = vocabulary(4, 700) | {"longest" * 60: 2, "longest" * 59 + "lonest": 3, "é" * 30: 2, "é" * 31: 9}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = [(r.a, r.b) for r in spelling.near_pairs(table, most).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in combinations(words, 2) if one_edit(*p)}


def test_forms_and_roots(spark):
    words = vocabulary(5, 600) | {f"chainaaa{'b' * i}": 2 * 10**i for i in range(9)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    formed = spelling.with_forms(table, spelling.near_pairs(table))
    assert found(spelling.with_roots(formed)) == brute(words)


def test_documents_against_brute_force(spark):
    rng = random.Random(6)
    stems = ["Wandering", "wanderer", "Ärgernisse", "mountains", "mountain", "naïveté×÷", "a" * 300]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "s", "-x", "1"]) for _ in range(40)), "en", "s") for i in range(60)]
    rows += [rows[0], (None, "wandering " * 30, "en", "s"), (7, None, None, None), (8, "", None, None), (9, "z" * 40_000 + " " + "z" * 40_000, "en", "s")]
    assert found(spelling.variants(documents(spark, rows))) == brute(brute_words(rows))


def test_awkward_rows(spark):
    assert spelling.variants(documents(spark)).count() == 0
    assert spelling.variants(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(documents(spark), ratio=1)
