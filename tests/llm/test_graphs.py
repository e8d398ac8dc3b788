"""Components against union-find."""

import random

import pytest

from plumbline.llm.graphs import components


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def graphs():
    r = random.Random(3)
    chain = list(range(60))
    r.shuffle(chain)
    yield "chain", list(zip(chain, chain[1:], strict=False))
    yield "star around the largest", [(99, i) for i in range(99)]
    yield "dense groups and a bridge", [(a, b) for o in (0, 100) for a in range(o, o + 25) for b in range(o, o + 25) if a != b] + [(24, 100)]
    yield "sparse", [(r.randrange(-150, 150), r.randrange(-150, 150)) for _ in range(140)]
    yield "loops and repeats", [(5, 5), (7, 6), (6, 7), (7, 6)]
    yield "leaves joined by large centres", [(1_000 + i, x) for i in range(30) for x in (i, i + 1, 200 - i)]


@pytest.mark.parametrize(("name", "edges"), list(graphs()))
def test_components(spark, name, edges):
    got = {x.v: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find(edges), name


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
