from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tenurelens.llm import token_counts
from tests.conftest import SMALL
from tests.llm.samples import documents, empty

BYTES, WORDS = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    "I'll don't they're  two blanks\n\nand lines\r\n\ttabs ",
    " leading", "\nleading line", "trailing\n", "a b c　d", "12345 6,7.8 %$#",
    "one <|endoftext|> two<|endoftext|><|endoftext|>", "<|EndOfText|>", "<|startoftext|>x", "<|endoftext|>",
    "Überraschung naïve café 東京タワー 👩‍👩‍👧 ́x", "x" * 5000, "''s '' 's", "\x00\x1f\x85", "Ñandú× a÷b Ã ño, \nÀ. x\nÿ!? (é) é's È", "ſtraße ĳ İ",
]


def expected(path, text):
    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("most", [0, 40, 1 << 17])
def test_counts_are_the_librarys(spark, monkeypatch, path, most):
    """Whether pre-tokens are common to all, to none or to some tasks."""
    monkeypatch.setattr(token_counts.common, "__defaults__", (most,))
    rows = [(i, t, "en", "s") for i, t in enumerate([*TEXTS, *TEXTS[:3], None, ""])]
    found = token_counts.count_tokens(documents(spark, rows), path, limit=20).collect()
    assert len(found) == len(rows)
    for r in found:
        text = rows[r.doc_id][1]
        n = expected(path, text)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((text or "").encode()), n > 20), text


def test_awkward_rows(spark):
    docs = documents(spark)
    found = sorted(map(repr, ((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, BYTES).collect())))
    assert found == sorted(map(repr, ((r.doc_id, expected(BYTES, r.text)) for r in docs.select("doc_id", "text").collect())))
    assert token_counts.count_tokens(empty(spark), BYTES).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, "piece.model")


def test_random_texts_and_small_hand_overs(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab '\n\téß1.<|>") for _ in range(rng.randint(0, 60))), "en", "s") for i in range(200)]
    docs = documents(spark, rows)
    assert sorted(map(tuple, token_counts.pretokens(docs, BYTES, held=5).collect())) == sorted(map(tuple, token_counts.pretokens(docs, BYTES).collect()))
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, BYTES).collect()}
    assert found == {i: expected(BYTES, t) for i, t, *_ in rows}


def test_pretokens_are_cut_once_and_the_common_ones_are_bounded(spark):
    docs = documents(spark, [(i, "tha tha wen x" + "y" * 100, "en", "s") for i in range(40)], extra=False)
    table = token_counts.pretokens(docs, BYTES)
    rows = {r.pretoken: r.n for r in table.collect()}
    assert len(rows) == table.count() and rows[" tha"] == 40
    assert set(token_counts.common(table, 3)) <= {b"tha", b" tha", b" wen"} and token_counts.common(table, 2) == {}


def test_the_query_counts_the_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts.query(spark, SMALL).collect()}
    tokenizer = Tokenizer.from_file(BYTES)
    expected_ = {d.doc_id: len(tokenizer.encode(d.text or "", add_special_tokens=False).ids) for d in docs}
    assert found == {k: (n, n > 512) for k, n in expected_.items()}
