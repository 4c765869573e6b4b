from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from verdex.operators import graph
from verdex.plans import skew


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def shapes(seed):
    r = random.Random(seed)
    names = r.sample(range(10_000), 600)
    path, star, ring, rest = names[:200], names[200:400], names[400:450], names[450:]
    links = list(zip(path, path[1:])) + [(star[0], x) for x in star[1:]] + list(zip(ring, [*ring[1:], ring[0]])) + [(r.choice(rest), r.choice(rest)) for _ in range(90)]
    r.shuffle(links)
    return [(b, a) if r.random() < 0.5 else (a, b) for a, b in links]


@pytest.mark.parametrize("hot", [10, 1000])
def test_components_of_paths_stars_and_rings(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    links = shapes(hot)
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    assert {r["node"]: r["component"] for r in graph.connected_components(df, max_rounds=14).collect()} == brute(links)


def test_no_links(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_the_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_ROWS", 7)
    rows = spark.createDataFrame([(i, 1 if i % 3 else i % 10) for i in range(200)], "i int, k int")
    other = spark.createDataFrame([(1, "a"), (0, "b"), (0, "c"), (3, "d"), (77, "e")], "k int, v string")
    hot = skew.hot_keys(rows, "k", rows.count())
    assert {r["k"]: r["_salts"] for r in hot.collect()}[1] > 10 and skew.hot_keys(rows.limit(5), "k", 5) is None
    got = skew.salted_join(rows, other, "k", hot, F.col("i"), how)
    assert sorted(map(repr, got.select("i", "k", "v").collect())) == sorted(map(repr, rows.join(other, "k", how).select("i", "k", "v").collect()))
