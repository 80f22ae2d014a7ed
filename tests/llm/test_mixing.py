from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st

from tenurelens.llm import mixing
from tests.llm.samples import documents, empty


def filled(sizes, most=3):
    """Targets by handing out the excess again and again."""
    weights = [i % 3 + 1 for i in range(len(sizes))]
    target, total, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        level = total / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > most * sizes[i]}
        for i in over or open_:
            target[i] = float(most * sizes[i]) if over else level * weights[i]
            total -= target[i] if over else 0
        if not over:
            break
        open_ -= over
    return target


def test_targets_hand_the_excess_to_the_others(spark):
    for sizes in ([10, 1000, 10, 10], [0, 5, 0], [7], [1, 1, 1, 1, 1, 1], [1000, 1, 1, 1]):
        rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
        found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        assert [found[f"s{i}"] for i in range(len(sizes))] == pytest.approx(filled(sizes))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_the_brute_force_shares_everything(sizes):
    assert sum(filled(sizes)) == pytest.approx(sum(sizes))


def test_awkward_rows(spark):
    docs = documents(spark)
    report = mixing.mix_report(docs).collect()
    assert len(report) == docs.count()
    assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in report)
    assert {r.size for r in report if r.doc_id in (3, 4, 7)} == {0}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in report)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix_report(empty(spark)).count() == 0


def test_reruns_agree(spark, rows):
    docs = documents(spark)
    assert rows(mixing.mix_report(docs)) == rows(mixing.mix_report(docs.repartition(5)))
