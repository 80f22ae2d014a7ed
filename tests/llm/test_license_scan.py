from __future__ import annotations

import random
import re
from collections import Counter

from tenurelens.llm import license_scan
from tests.llm.samples import documents, empty


def words(text):
    return re.findall(r"[0-9a-z]+", text.lower())


def brute(text, templates, threshold):
    """Every span of every text against every template."""
    pairs = list(zip(words(text), words(text)[1:]))
    found = []
    for name, t in templates.items():
        template = set(zip(words(t), words(t)[1:]))
        best = None
        for a in range(len(pairs)):
            for b in range(a + 1, len(pairs) + 1):
                score = 2 * len(set(pairs[a:b]) & template) / (b - a + len(template))
                if score >= threshold and (best is None or score > best[0]):
                    best = (score, a, b - a)
        if best:
            found.append((name, *best))
    kept = []
    for m in sorted(found, key=lambda m: (-m[1], m[0])):
        if all(m[2] > k[2] + k[3] or k[2] > m[2] + m[3] for k in kept):
            kept.append(m)
    return {(name, round(score, 9), a, n + 1) for name, score, a, n in kept}


def test_against_all_spans(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        t = words(rng.choice(list(license_scan.TEMPLATES.values())))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(["the", "foo", "3", "under"])
        filler = [rng.choice("a b the under license version 3".split()) for _ in range(rng.randint(0, 8))]
        at = rng.randint(0, len(filler))
        texts.append(" ".join([*filler[:at], *t, *filler[at:]]))
    found = license_scan.scan(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    for i, t in enumerate(texts):
        own = {(r.license, round(r.score, 9), r.first_word, r.n_words) for r in found if r.doc_id == i}
        assert own == brute(t, license_scan.TEMPLATES, 0.8), t


def test_versions_and_awkward_rows(spark):
    rows = [(1, "x y THIS work\nis licensed (under) the GNU General Public License; version 3", "en", "s"), (2, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "en", "s"), (2, None, "en", "s"), (None, "Released under the MIT License", "en", "s"), (3, "released " * 20_000, "en", "s")]
    found = sorted((str(r.doc_id), r.license, r.score, r.first_word) for r in license_scan.scan(documents(spark, rows)).collect())
    assert found == [("1", "GPL-3.0", 1.0, 2), ("2", "CC-BY-NC-4.0", 1.0, 5), ("2", "MIT", 1.0, 0), ("None", "MIT", 1.0, 0)]
    assert license_scan.scan(empty(spark)).count() == 0
    assert license_scan.scan(documents(spark)).count() == 0


def brute_all(text, templates, threshold):
    """Every span of every template, best first, without those that overlap one taken before; each licence's first."""
    pairs = list(zip(words(text), words(text)[1:]))
    found = []
    for name, t in templates.items():
        template = Counter(zip(words(t), words(t)[1:]))
        for a in range(len(pairs)):
            for b in range(a + 1, len(pairs) + 1):
                score = 2 * (Counter(pairs[a:b]) & template).total() / (b - a + template.total())
                if score >= threshold:
                    found.append((-score, name, a, b - a))
    kept, best = [], {}
    for score, name, a, n in sorted(found):
        if all(a > k + m or k > a + n for k, m in kept):
            kept.append((a, n))
            best.setdefault(name, (name, round(-score, 9), a, n + 1))
    return set(best.values())


def test_a_span_elsewhere_survives_the_overlap_of_the_best_one(spark):
    gpl = ["This work is licensed under the GNU General Public License, version 3.", "The bundled parser is licensed under the GNU General Public License version 2."]
    found = license_scan.scan(documents(spark, [(1, " ".join(gpl), "en", "s")])).collect()
    assert sorted((r.license, r.score, r.first_word, r.n_words) for r in found) == [("GPL-2.0", 0.9, 15, 10), ("GPL-3.0", 1.0, 0, 12)]


def test_against_all_spans_of_all_templates(spark):
    rng = random.Random(3)
    templates = {"x": "a b c a b d", "y": "a b c a b e", "z": "c a b a b a b", "w": "d e a", "v": "a"}
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    found = license_scan.scan(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), templates, 0.6).collect()
    for i, t in enumerate(texts):
        own = {(r.license, round(r.score, 9), r.first_word, r.n_words) for r in found if r.doc_id == i}
        assert own == brute_all(t, templates, 0.6), t


def test_standard_notices_and_full_texts(spark):
    gpl = "This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by\n# the Free Software Foundation, either version {} of the License, or (at your option) any later version.\n# Foo is distributed in the hope that it will be useful"
    notices = [("GPL-3.0", gpl.format("General Public License", "3")), ("GPL-2.0", gpl.format("General Public License", "2")), ("LGPL-2.1", gpl.format("Lesser General Public License", "2.1")), ("AGPL-3.0", gpl.format("Affero General Public License", "3"))]
    full = [(n, t) for n, t in license_scan.standard_templates() if len(words(t)) > 100]
    assert {"GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Apache-2.0", "BSD-3-Clause", "ISC", "Unlicense", "EPL-2.0", "MIT"} <= {n for n, _ in full}
    cases = [*notices, *((n, "Copyright 2020 A. Person " + " ".join(w if i % 97 else "other" for i, w in enumerate(words(t), 1))) for n, t in full)]
    found = license_scan.scan(documents(spark, [(i, t, "en", "s") for i, (_, t) in enumerate(cases)])).collect()
    aside = {"MIT-permission", "BSD-conditions"}
    assert {i: {r.license for r in found if r.doc_id == i} - aside for i in range(len(cases))} == {i: {n} for i, (n, _) in enumerate(cases)}
