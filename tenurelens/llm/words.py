"""Words and word shingles of whole texts, hashed in numpy.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab,
form feed and carriage return, with A-Z lower-cased. All texts of a batch are one
byte array; words and shingles are hashed by prefix sums over it, so no Python
code runs per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, _MASK, 256, dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _ODD, np.uint64)
        down = np.full(size, _ODD_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


@dataclass
class Words:
    """All words of a batch of texts: hashes, place in ``raw``, and per text the index of its first word, one more at the end."""

    raw: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray
    stops: np.ndarray
    first: np.ndarray
    #: Where each text begins in ``raw``; behind each text is a line feed.
    texts: np.ndarray


def words_of(texts: list[bytes], table: np.ndarray | None = LOWER) -> Words:
    """``table`` maps bytes before words are sought; None leaves them."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    raw = raw if table is None else table[raw]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    blank = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    begins, stops = edge[0::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[raw] * up[: len(raw)])])
    hashes = mix((sums[stops] - sums[begins]) * down[begins])
    starts = np.concatenate([[0], ends])
    return Words(raw, hashes, begins, stops, np.searchsorted(begins, starts), starts[:-1])


def shingle_runs(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words, repeats included, and where each text begins.

    A text with fewer words is one shingle, its whole sequence; one without words has none.
    """
    found = words_of(texts)
    words, first = found.hashes, found.first
    n = np.diff(first)
    runs = np.full(max(len(words) - size + 1, 0), size, dtype=np.uint64)
    for k in range(size):
        runs = mix(runs + words[k : k + len(runs)], k + 1)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(starts[-1], dtype=np.uint64)
    if len(out):
        # position of each shingle's first word; a short text keeps a place that is overwritten below
        at = np.arange(len(out)) + np.repeat(first[:-1] - starts[:-1], count)
        whole = at < len(runs)
        out[whole] = runs[at[whole]]
        for i in np.flatnonzero((n > 0) & (n < size)):
            h = np.full(1, n[i], dtype=np.uint64)
            for k in range(n[i]):
                h = mix(h + words[first[i] + k], k + 1)
            out[starts[i]] = h[0]
    return out, starts


def blocks(items: list, weight, most: int):
    """Consecutive slices of ``items`` whose weights add up to about ``most``; a heavier item stands alone."""
    out, total = [], 0
    for x in items:
        w = weight(x)
        if out and total + w > most:
            yield out
            out, total = [], 0
        out.append(x)
        total += w
    if out:
        yield out


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Consecutive slices of a batch whose texts in ``column`` add up to about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    at = 0
    for part in blocks(sizes.tolist(), lambda n: n + 1, most):
        yield batch.slice(at, len(part))
        at += len(part)
