from __future__ import annotations

import random
import re

from tenurelens.llm import line_dedup
from tests.llm.samples import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(texts, least):
    """Marks every line of every run of ``least`` words or more that also begins earlier."""
    lines = [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    gone, seen = set(), {}
    for d, t in enumerate(texts):
        seq = t.split("\n")
        for i in range(len(seq)):
            for j in range(i + 1, len(seq) + 1):
                run = tuple(seq[i:j])
                if sum(len(WORD.findall(x)) for x in run) >= least:
                    if run in seen and seen[run] < (d, i):
                        gone |= {(d, k) for k in range(i, j)}
                    seen.setdefault(run, (d, i))
    return ["\n".join(x for e, k, x in lines if e == d and (d, k) not in gone) for d in range(len(texts))]


def test_against_all_runs(spark):
    rng = random.Random(11)
    for least in (4, 7):
        texts = ["\n".join(" ".join("xy"[rng.random() < 0.3] for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 14))) for _ in range(25)]
        rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
        found = line_dedup.dedup_lines(documents(spark, rows), min_words=least).orderBy("doc_id").collect()
        assert [r.text for r in found] == brute(texts, least)


def test_a_long_passage_goes_from_later_documents_only(spark):
    passage = "\n".join(f"line {i} of a passage with nine words here" for i in range(6))
    rows = [(1, f"own\n{passage}\nend", "en", "s"), (2, f"{passage}\n\n\nother", "en", "s"), (3, "clean text", "en", "s"), (4, passage, "en", "s")]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert found[1].text == rows[0][1] and found[3].text == "clean text"
    assert found[2].text == "other" and found[2].lines_deleted == 6 and found[2].lines_total == 7
    assert found[4].text == "" and found[4].lines_deleted == found[4].lines_total == 6


def test_awkward_rows(spark):
    docs = documents(spark)
    found = line_dedup.dedup_lines(docs).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found}
    assert by[3].text is None and by[4].text == "" and by[7].text == " \n\t \n" and by[7].lines_total == 0
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_plan_has_no_python(spark, capsys):
    line_dedup.dedup_lines(documents(spark, extra=False)).explain()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", capsys.readouterr().out)
