"""Connected components against a union-find on random graphs, chains and stars."""

import random

import pytest

from grantlens.operators.components import connected_components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(200)],
    [(500, i) for i in range(100)] + [(7, 7), (None, 3), (3, None), (1, 2), (2, 1)],
    [(random.Random(4).randrange(80), x) for x in (random.Random(i).randrange(80) for i in range(60))],
], ids=["chain", "star", "random"])
def test_components_match_union_find(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
