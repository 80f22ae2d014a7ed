from __future__ import annotations

import numpy as np
import pytest

from tenurelens.llm import neighbours, vector_dedup

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as row", "2 as list", "3 as key")


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return centres[rng.integers(0, 12, n)] + rng.normal(scale=rng.choice([0.02, 0.15, 0.5], size=(n, 1)), size=(n, width))


def test_recall_and_order_of_neighbours(spark):
    x = clustered(1500, 24, 3) * np.random.default_rng(9).uniform(0.2, 3, (1500, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    found = neighbours.search(vectors(spark, rows), settings=neighbours.Settings(list_size=64, block=100, query_block=10)).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 1500, 20))
    hits = 0
    for q, own in by.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and q not in [r.vec_id for r in own]
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in own)
        assert [r.score for r in own] == sorted((r.score for r in own), reverse=True)
        order = [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]
        hits += len(set(order) & {r.vec_id for r in own})
    assert hits >= 0.95 * 20 * len(by)


def test_graph_finds_the_nearest_centroids():
    x = clustered(3000, 16, 5)
    centroids = neighbours.bisect(x, 300, 1)
    assert len(centroids) == 300
    graph = neighbours.Graph.over(centroids, 16)
    ids, d = graph.nearest(x[:200], 24)
    assert (np.diff(d, axis=1) >= 0).all()
    exact = ((x[:200, None, :] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (ids[:, 0] == exact).mean() >= 0.95


@pytest.mark.parametrize("seed", [1, 2, 3, 5])
def test_graph_reaches_the_nearest_at_every_seed_without_measuring_all(seed, monkeypatch):
    x = clustered(6000, 16, seed)
    graph = neighbours.Graph.over(neighbours.bisect(x, 900, seed), 16)
    measured, real = set(), neighbours.Graph._distances
    monkeypatch.setattr(neighbours.Graph, "_distances", lambda self, q, to: measured.update(to.reshape(-1).tolist()) or real(self, q, to))
    graph.nearest(x[:1], 24)
    assert 24 < len(measured) < 600
    ids, _ = graph.nearest(x[:200], 24)
    exact = ((x[:200, None, :] - graph.centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (ids[:, 0] == exact).mean() >= 0.99
    assert all(len(set(row)) == 24 for row in ids.tolist())
    once, few = neighbours.Graph(graph.centroids[:1], np.zeros((1, 1), np.int64)), neighbours.Graph.over(graph.centroids[:3], 16)
    assert once.nearest(x[:5], 24)[0].tolist() == [[0]] * 5 and sorted(few.nearest(x[:1], 24)[0][0].tolist()) == [0, 1, 2]


def test_queries_read_few_lists_and_find_their_neighbours():
    """The ratio follows the vectors: near clusters few lists are read, and the wanted share is found."""
    s = neighbours.Settings()
    x = clustered(8000, 24, 4)
    most = (x**2).sum(axis=1).max()
    lifted = neighbours._lifted(x, most)
    graph = neighbours.Graph.over(neighbours.bisect(lifted, 200, 1), s.degree)
    ratio = neighbours.calibrated(graph, lifted, 20, s)
    ids, d = graph.nearest(lifted, s.beam)
    held = neighbours._replicated(d, s)
    stored = [set(i[h].tolist()) for i, h in zip(ids[:, : s.replicas], held, strict=True)]
    q = np.concatenate([x[::40], np.zeros((200, 1))], axis=1)
    q *= (most**0.5 / np.linalg.norm(q, axis=1))[:, None]
    read = {}
    for rows, near, far in graph.within(q, ratio, s.beam):
        read |= {int(r): set(i[e <= (1 + ratio) * e[0]].tolist()) for r, i, e in zip(rows, near, far, strict=True)}
    hits = 0
    for n, i in enumerate(range(0, 8000, 40)):
        products = x @ x[i]
        products[i] = -np.inf
        hits += sum(bool(stored[j] & read[n]) for j in np.argsort(-products)[:20])
    assert hits / (200 * 20) >= 0.93
    assert np.mean([len(v) for v in read.values()]) < 0.5 * len(graph.centroids)


def test_neighbours_of_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (1, [2.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [NAN, 1.0], 1), (40, [INF, 1.0], 1), (60, [None, 1.0], 1)]
    rows += [(None, [1.0, 1.0], 1), (5, [1.0], 1), (5, [1.0], 1), (6, [0.0, -1.0], 1), (8, [1.0, 0.0], None)]
    found = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.search(vectors(spark, rows)).collect())
    assert found == [(0, 1, 1), (0, 2, 5), (0, 3, 8), (0, 4, 20), (0, 5, 6), (20, 1, 1), (20, 2, 0), (20, 3, 5), (20, 4, 8), (20, 5, 6)]
    assert neighbours.search(vectors(spark, rows).limit(0)).count() == 0


def brute(rows, threshold):
    links, up = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la is not None and la == lb and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [(rows[i][0], links[i], rows[top(i)][0]) for i in range(len(rows))]


def test_links_and_components_against_all_pairs(spark):
    x = clustered(500, 10, 8)
    rows = [(i, v.tolist(), i % 3 if i % 50 else None) for i, v in enumerate(x)]
    found = vector_dedup.near_duplicates(vectors(spark, rows), settings=vector_dedup.Settings(tile=16, leading=2)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.n_links, r.component_id) for r in found] == brute(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert max(r.n_links for r in found) > 5


def test_duplicates_among_awkward_rows(spark):
    rows = [(1, [1.0, 0.0], 7), (2, [1.0, 0.0], 7), (2, [5.0, 0.1], 7), (3, [0.0, 0.0], 7), (4, None, 7), (5, [NAN, 1.0], 7), (None, [1.0, 0.0], 7), (6, [1.0], 7), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 8), (None, None, None)]
    found = vector_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert len(found) == len(rows)
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in found if r.n_links) == sorted(
        map(str, [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False), (6, 4, 1, False)])
    )
    assert all(r.component_id == r.vec_id and r.kept for r in found if not r.n_links)
    assert vector_dedup.near_duplicates(vectors(spark, rows).limit(0)).count() == 0
