from __future__ import annotations

import random
from pathlib import Path

from tenurelens.llm.components import connected_components
from tenurelens.sources.workspace import run_folder


def test_components_of_paths_stars_and_nulls(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 4), (900, 901)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert found == {x: top(x) for x in list(up)}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_round_takes_the_place_of_the_one_before(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with run_folder(spark) as folder:
        assert connected_components(links).where("component = 0").count() == 41
        assert len(list(Path(folder.removeprefix("file://")).glob("*/links"))) == 1
