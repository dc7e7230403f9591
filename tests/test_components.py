"""Connected components against union-find, with their rounds counted."""

import random

import pytest

from longweave.operators import components, joins


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def chain(n, order):
    ids = list(range(n))
    if order == "mixed":
        random.Random(1).shuffle(ids)
    return list(zip(ids, ids[1:], strict=False))


@pytest.mark.parametrize("order", ["in order", "mixed"])
def test_long_chain_in_few_rounds(spark, monkeypatch, order):
    labels = []
    real = components.saved
    monkeypatch.setattr(components, "saved", lambda df, label="step": (labels.append(label), real(df, label))[1])
    edges = chain(10_000, order)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == plain(edges)
    assert labels.count("jumps") + labels.count("labels") <= 40 and labels.count("labels") <= 8
    if order == "in order":
        assert labels.count("jumps") + labels.count("labels") <= 18


def test_random_graphs(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, i) for i in range(1001, 1400)]
    rows = [*edges, (5, None), (None, 7), (2000, 2000), edges[0], edges[0][::-1]]
    want = plain([(a, b) for a, b in edges if a != b])
    df = spark.createDataFrame(rows, "a long, b long")
    for most in (components.BROADCAST_VERTICES, 0):  # 0: by salted joins
        monkeypatch.setattr(components, "BROADCAST_VERTICES", most)
        assert {r["node"]: r["component"] for r in components.connected_components(df).collect()} == want
    assert components.connected_components(df.where("false")).count() == 0


def test_salted_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (3, 0), (None, 0)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k long, x string")
    for how in ("inner", "left"):
        got = joins.salted_join(left, right, "k", "v", how, heavy=7).select("k", "v", "x")
        assert sorted(got.collect(), key=str) == sorted(left.join(right, "k", how).select("k", "v", "x").collect(), key=str)
