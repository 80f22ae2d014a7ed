from __future__ import annotations

import random
import zlib

from tenurelens.llm import language_id
from tests.llm.samples import documents, empty

PARTS = {"aa": "tha wen ing sho".split(), "bb": "zük schö ßen bär".split(), "cc": "ção não lhe rão".split()}


def labelled(n):
    rng = random.Random(5)
    return [(i, " ".join("".join(rng.choices(PARTS[k], k=2)) for _ in range(rng.randint(3, 60))), k, "s") for i in range(n) for k in [rng.choice(sorted(PARTS))]]


def test_held_out_accuracy_and_unknowns(spark):
    rows = labelled(500) + [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "12 34 !!", None, "s"), (None, "thawen shoing " * 30_000, None, "s")]
    docs = documents(spark, rows)
    found = language_id.identify(docs).collect()
    assert len(found) == len(rows)
    right = {i: k for i, _, k, _ in rows[:500]}
    held = [r for r in found if r.held_out and r.doc_id in right]
    assert len(held) > 50 and sum(r.lang_pred == right[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r for r in found}
    assert by[1000].lang_pred == by[1001].lang_pred == by[1002].lang_pred == "und" and by[None].lang_pred == "aa"


def test_nothing_to_learn(spark):
    found = language_id.identify(documents(spark, [(1, "abc", None, "s"), (2, None, "en", "s")])).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] * 2
    assert language_id.identify(empty(spark)).count() == 0


def test_windows_cover_the_whole_text():
    text = "é" * 1000
    assert language_id.windows(text, 64).tobytes().rstrip(b"\0") == text.encode()
