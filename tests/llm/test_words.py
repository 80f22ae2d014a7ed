from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tenurelens.llm.encoder import Encoder
from tenurelens.llm.words import blocks, shingle_runs, words_of

TEXTS = st.text(alphabet=" \n\t\r\x0b\x0c\x1c\xa0　abAB1.'sé́ß", max_size=40)


def words(text: str) -> list[bytes]:
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return [w.translate(lower) for w in re.findall(rb"[^\x20\x09-\x0d]+", text.encode())]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_words_and_shingles_are_told_apart(texts):
    found = words_of([t.encode() for t in texts])
    seen, back = {}, {}
    for i, t in enumerate(texts):
        own = found.hashes[found.first[i] : found.first[i + 1]].tolist()
        for h, w in zip(own, words(t), strict=True):
            assert seen.setdefault(h, w) == w and back.setdefault(w, h) == h
    runs, first = shingle_runs([t.encode() for t in texts], 3)
    seen, back = {}, {}
    for i, t in enumerate(texts):
        w = words(t)
        expected = [tuple(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] if w else []
        for h, s in zip(runs[first[i] : first[i + 1]].tolist(), expected, strict=True):
            assert seen.setdefault(h, s) == s and back.setdefault(s, h) == h


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_whole_text(name):
    encode = Encoder(public_tokenizers.path(name))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(TEXTS, max_size=5))
    def check(texts):
        direct = [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encode(texts, 2)] == [ids + [2] for ids in direct]

    check()
    encode.known.forget()
    check()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_encoded_as_the_library_does(name):
    encode, fresh = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in added
    texts = ["foo bar", *(x for t in added for x in (t, f"foo {t} bar", f"foo{t}bar\n{t}", f"foo  {t.upper()} bar", t[:-1], f"{t}{t}"))]
    direct = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in encode(texts, 2)] == [ids + [2] for ids in direct]
    if name == "byte_bpe_50k.json":
        assert encode(["foo <|endoftext|> bar"])[0].tolist() == [21943, 220, 50256, 2318]


def test_blocks_keep_order_and_lose_nothing():
    parts = list(blocks([1, 2, 50, 3, 4], lambda x: x, 6))
    assert [x for p in parts for x in p] == [1, 2, 50, 3, 4] and [50] in parts
    assert list(blocks([], lambda x: x, 6)) == []
    assert np.concatenate([[], []]).size == 0
