import random

import pytest

from tallyfold.llm.components import components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["path", "star", "random", "cycle"])
def test_against_union_find(spark, kind):
    rnd = random.Random(3)
    edges = {
        "path": [(i, i + 1) for i in range(150)],
        "star": [(77, i) for i in range(200)],
        "random": [(rnd.randint(-150, 150), rnd.randint(-150, 150)) for _ in range(140)],
        "cycle": [(i, (i + 1) % 40) for i in range(40)] + [(500, 501), (501, 500), (7, 7)],
    }[kind]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == plain([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
