"""Licence notices in texts, by the Dice coefficient of word bigrams with templates.

Texts are normalised: letters a-z and A-Z alike, digits, and everything beyond ASCII make words, all
else parts them. A span of words is compared with a template by their bigrams, repeats
counted. A span must begin and end with a bigram of the template, and the coefficient bounds
its size, which leaves few spans of few templates to measure.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenurelens.llm.words import LOWER, mix, slices, words_of

THRESHOLD = 0.8
BATCH_BYTES = 2_000_000

# Wordings of common licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
}

_FSF = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
_LATER = _FSF + ", either version {} of the License, or (at your option) any later version."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"

#: Further notices, as they stand at the head of files.
NOTICES = [
    *(("GPL-" + v, _LATER.format(_GPL, v[0])) for v in ("1.0", "2.0", "3.0")),
    ("LGPL-2.0", _LATER.format("Library General Public License", "2")),
    ("LGPL-2.1", _LATER.format(_LGPL, "2.1")),
    ("LGPL-3.0", _LATER.format(_LGPL, "3")),
    ("AGPL-3.0", _LATER.format(_AGPL, "3")),
    *(("GPL-" + v, _FSF.format(f"{_GPL} version {v[0]}")) for v in ("2.0", "3.0")),
    *(("GPL-" + v, _FSF.format(_GPL) + f", version {v[0]}.") for v in ("2.0", "3.0")),
    ("LGPL-2.1", _FSF.format(_LGPL) + ", version 2.1."),
    ("LGPL-3.0", _FSF.format(_LGPL) + ", version 3."),
    ("AGPL-3.0", _FSF.format(_AGPL) + ", version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
]


def standard_templates() -> list[tuple[str, str]]:
    """(licence, wording) of all notices, and of the full texts in ``licences``."""
    full = sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in resources.files("tenurelens.llm").joinpath("licences").iterdir() if f.name.endswith(".txt"))
    return [*TEMPLATES.items(), *NOTICES, *full]


#: Bytes of words stay, A-Z in lower case; all others become blanks.
_NORMAL = LOWER.copy()
_NORMAL[[b for b in range(128) if not chr(b).isalnum()]] = 32


def bigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word bigrams, and where each text's begin."""
    w = words_of(texts, _NORMAL)
    pairs = mix(mix(w.hashes[:-1], 1) + w.hashes[1:], 2)
    count = np.maximum(np.diff(w.first) - 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], count)
    return pairs[at], first


class _Places:
    """Where a template's bigrams are in a text.

    A bigram counts in a span as often as in the template at most. A span of n bigrams shares n of
    them at most, so n is at most (2 - t) / t times the template's. A span that begins or ends with a
    foreign bigram is less alike than the one without it.
    """

    def __init__(self, text: np.ndarray, template: np.ndarray, threshold: float):
        own, times = np.unique(template, return_counts=True)
        at = np.minimum(np.searchsorted(own, text), len(own) - 1)
        self.hits = np.flatnonzero(own[at] == text)
        which = at[self.hits]
        self.size, self.threshold = len(template), threshold
        self.most = int(self.size * (2 - threshold) / threshold + 1e-9)
        self.shared = int(np.minimum(np.bincount(which, minlength=len(own)), times).sum())
        # a bigram counts in spans that begin behind the one which is as many repeats before as the template has
        order = np.argsort(which, kind="stable")
        before = np.arange(len(order)) - times[which[order]]
        fits = (before >= 0) & (which[order][np.maximum(before, 0)] == which[order])
        self.full = np.full(len(order), -1)
        self.full[order[fits]] = self.hits[order[before[fits]]]

    def best(self, k: int, last: int) -> tuple[float, int, int] | None:
        """(score, first bigram, number of bigrams) of the best span from hit ``k`` that ends at bigram ``last`` at most; ties to the shortest."""
        start = int(self.hits[k])
        stop = np.searchsorted(self.hits, min(start + self.most - 1, last), "right")
        n = self.hits[k:stop] - start + 1
        if not len(n):
            return None
        score = 2 * np.cumsum(self.full[k:stop] < start) / (n + self.size)
        i = int(score.argmax())
        return (float(score[i]), start, int(n[i])) if score[i] >= self.threshold else None


def matches(text: np.ndarray, templates: list[tuple[str, np.ndarray]], threshold: float) -> list[tuple[str, float, int, int]]:
    """Each licence's best span, of all that no better span overlaps; ties by name, then to the first, then the shortest.

    The spans of all templates are taken best first. Only the best span from each place is at
    hand; where a span taken later on that place's right is in its way, the best one before that follows.
    """
    places, heap = [], []
    for name, template in templates:
        if not len(template):
            continue
        p = _Places(text, template, threshold)
        # a span can share no more than the whole text does
        if 2 * p.shared >= threshold * (p.size + p.shared):
            heap += [(-m[0], name, *m[1:], len(places), k) for k in range(len(p.hits)) if (m := p.best(k, len(text)))]
            places.append(p)
    heapq.heapify(heap)
    best: dict[str, tuple[str, float, int, int]] = {}
    begins: list[int] = []
    ends: list[int] = []
    while heap:
        score, name, start, n, t, k = heapq.heappop(heap)
        # spans of words: n bigrams cover n + 1 words
        right = bisect_right(begins, start)
        if right and ends[right - 1] >= start:
            continue
        if right < len(begins) and begins[right] <= start + n:
            if m := places[t].best(k, begins[right] - 2):
                heapq.heappush(heap, (-m[0], name, *m[1:], t, k))
            continue
        begins.insert(right, start)
        ends.insert(right, start + n)
        best.setdefault(name, (name, -score, start, n))
    return list(best.values())


def _scan(templates: list[tuple[str, str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, first = bigrams([t.encode() for _, t in templates])
        known = [(n, hashes[a:b]) for (n, _), a, b in zip(templates, first[:-1], first[1:], strict=True)]
        every, which = np.unique(hashes, return_inverse=True)
        # how often each bigram is in each template
        times = np.zeros((len(every), len(known)), np.int32)
        np.add.at(times, (which, np.repeat(np.arange(len(known)), np.diff(first))), 1)
        need = np.diff(first) * threshold / (2 - threshold) - 1e-6
        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                texts = [t or b"" for t in some["text"].cast(pa.binary()).to_pylist()]
                pairs, begin = bigrams(texts)
                at = np.minimum(np.searchsorted(every, pairs), len(every) - 1)
                found = every[at] == pairs
                hit = np.concatenate([[0], np.cumsum(found)])[begin]
                docs, rows = some["doc_id"], []
                for i in np.flatnonzero(hit[1:] > hit[:-1]).tolist():
                    text = slice(begin[i], begin[i + 1])
                    own, n = np.unique(at[text][found[text]], return_counts=True)
                    likely = np.flatnonzero(np.minimum(times[own], n[:, None]).sum(axis=0) >= need).tolist()
                    if likely:
                        rows += [(i, *m) for m in matches(pairs[text], [known[t] for t in likely], threshold)]
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] + 1 for r in rows], pa.int64())],
                    ["doc_id", "license", "score", "first_word", "n_words"],
                )

    return run


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per licence found in a document: doc_id, license, score, first_word, n_words.

    A document has a licence where a span of its words reaches ``threshold``; a span that overlaps one
    that is more like another template doesn't count, so versions of a notice aren't taken for each
    other; the row has the best span that counts. Documents without a licence, NULL and empty texts have no rows; a repeated row has its
    rows again. Templates of one word have no bigrams and match nothing.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(_scan(list(templates.items()) if templates else standard_templates(), threshold), f"doc_id {kind}, license string, score double, first_word long, n_words long")
    return found.withColumnRenamed("doc_id", key)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
