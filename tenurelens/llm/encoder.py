"""Token ids of whole texts by a public tokenizer file, with each distinct word encoded once while it is remembered.

Both kinds of file known here never merge across a lone blank or line feed between words, so
a text's ids are those of its pieces in order. Words are told apart by 64-bit hashes in
numpy; only words not yet known go to the tokenizer. A text with other white space, where
it matters, or with an added token's content, such as ``<|endoftext|>``, which the library
gives the token's one id, and any other kind of file is encoded in one go. The ids are those
that a fresh tokenizer gives the whole text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from tenurelens.llm.words import mix, words_of
from tenurelens.llm.worker import kept

#: Words that a worker remembers; when full, the half met least often is forgotten.
CACHE_WORDS = 600_000
_AT_A_TIME = 2_000
#: Words that the library gets as one text; more don't make a word cheaper.
_SIDE_BY_SIDE = 50

_RARE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BEFORE = (" ", "\n", "")


class _Known:
    """Ids of words by the words' keys, sorted."""

    def __init__(self):
        self.keys, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, keys: np.ndarray, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """``keys``: not known yet, sorted; ``start`` and ``length``: their places in ``ids``."""
        start = start + len(self.pool)
        self.pool = np.concatenate([self.pool, ids])
        # both are sorted, so each array is merged in one step, which lots of any size can afford
        at = np.searchsorted(self.keys, keys)
        self.keys, self.met = np.insert(self.keys, at, keys), np.insert(self.met, at, 0)
        self.start, self.length = np.insert(self.start, at, start), np.insert(self.length, at, length)

    def forget(self) -> None:
        """Keeps the half met most often, and half of the counts."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: len(self.keys) // 2])
        start, length = self.start[keep], self.length[keep]
        self.pool = self.pool[_spans(start, length)]
        self.keys, self.met, self.length = self.keys[keep], self.met[keep] // 2, length
        self.start = np.cumsum(length) - length


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the spans given, one behind the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(length.sum())


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=sum(map(len, ids)))


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        #: Added tokens, found in normalised text or before it; None where there are none.
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        plain = not spec["normalizer"] and before.get("type") == "ByteLevel"
        #: A blank belongs to the word behind it.
        self.attached = bool(plain and before.get("use_regex") and not before.get("add_prefix_space"))
        #: White space is dropped.
        self.dropped = (spec["model"].get("end_of_word_suffix") or "") == "</w>" and bool(spec["normalizer"])
        self.opens = self._opening(added) if self.attached else None
        self.known = _Known()

    def _opening(self, added: list[str]) -> np.ndarray | None:
        """Which ids begin with a blank: in words side by side, each led by a blank, these are the words' first."""
        vocabulary = self.tokenizer.get_vocab()
        if "\u0120" not in vocabulary or any(c.isspace() for content in added for c in content):
            return None
        opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        return opens

    def _encode(self, texts: list[str], at_a_time: int = _AT_A_TIME) -> list[list[int]]:
        # the library's results are far larger than the ids, so they are not held for many texts at a time
        parts = (texts[a : a + at_a_time] for a in range(0, len(texts), at_a_time))
        return [e.ids for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _encode_words(self, words: list[str], led: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, and each word's start and length in them; ``led`` tells which begin with a blank."""
        if self.opens is None:
            led = np.zeros(len(words), dtype=bool)
        joined = [w for w, blank in zip(words, led.tolist(), strict=True) if blank]
        texts = ["".join(joined[a : a + _SIDE_BY_SIDE]) for a in range(0, len(joined), _SIDE_BY_SIDE)]
        ids = _flat(self._encode(texts, _AT_A_TIME // _SIDE_BY_SIDE))
        first = np.flatnonzero(self.opens[ids]) if len(ids) else np.zeros(0, np.int64)
        if len(first) != len(joined):
            # a file that treats words in company otherwise, such as one that cuts long texts
            self.opens = None
            return self._encode_words(words, led)
        others = self._encode([w for w, blank in zip(words, led.tolist(), strict=True) if not blank])
        start, length = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        length[led] = np.diff(first, append=len(ids))
        length[~led] = np.fromiter(map(len, others), dtype=np.int64, count=len(others))
        start[led], start[~led] = first, len(ids) + np.cumsum(length[~led]) - length[~led]
        return np.concatenate([ids, _flat(others)]), start, length

    def _whole(self, texts: list[str], raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which texts have white space or added tokens that must be seen as a whole."""
        if not (self.attached or self.dropped):
            return np.ones(len(texts), dtype=bool)
        odd = np.fromiter((self.added is not None and self.added.search(t) is not None for t in texts), dtype=bool, count=len(texts))
        if self.attached:
            blank = (raw == 32) | (raw == 10)
            pair = np.flatnonzero(blank[1:] & blank[:-1])
            control = np.flatnonzero((raw >= 9) & (raw <= 13) & (raw != 10))
            at = np.concatenate([pair, pair + 1, control])
            text = np.searchsorted(starts, at, "right") - 1
            # the line feed behind a text isn't part of it
            ends = np.concatenate([starts[1:], [len(raw)]]) - 1
            odd[text[at < ends[text]]] = True
            odd |= np.fromiter((not t.isascii() and _RARE_SPACE.search(t) is not None for t in texts), dtype=bool, count=len(texts))
        return odd

    def __call__(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """uint32 ids of each text, with ``end`` appended."""
        tail = np.array([] if end is None else [end], dtype=np.uint32)
        if not texts:
            return []
        w = words_of([t.encode("utf-8") for t in texts], table=None)
        odd = self._whole(texts, w.raw, w.texts)
        count = np.diff(w.first)
        use = np.repeat(~odd, count)
        keys, begins, stops = w.hashes[use], w.begins[use], w.stops[use]
        if self.attached:
            state = np.where(w.raw[begins - 1] == 32, 0, 1)
            state[np.isin(begins, w.texts)] = 2
            keys = mix(keys + state.astype(np.uint64), 9)
        else:
            state = np.full(len(keys), 2)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        known = self.known
        at = np.searchsorted(known.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(known.keys)
        new[inside] = known.keys[at[inside]] != distinct[inside]
        if new.any():
            data, some = w.raw.tobytes(), first[new]
            words = [_BEFORE[s] + data[a:b].decode("utf-8") for s, a, b in zip(state[some].tolist(), begins[some].tolist(), stops[some].tolist(), strict=True)]
            known.add(distinct[new], *self._encode_words(words, state[some] == 0))
            at = np.searchsorted(known.keys, distinct)
        known.met[at] += 1
        start, length = known.start[at][inverse], known.length[at][inverse]
        ids = known.pool[_spans(start, length)]
        count[odd] = 0
        word = np.concatenate([[0], np.cumsum(count)])
        cuts = np.concatenate([[0], np.cumsum(length)])[word]
        out = []
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            out.append(np.concatenate([np.array(self._encode([texts[i]])[0], dtype=np.uint32) if odd[i] else ids[a:b], tail]))
        if len(known.keys) > CACHE_WORDS:
            known.forget()
        return out


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))
