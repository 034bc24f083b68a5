"""Components: rounds grow with the logarithm of the nodes, whatever the graph and its names."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import split


def graphs(n):
    rng = random.Random(3)
    names = list(range(n))
    rng.shuffle(names)
    return {
        "ascending chain": [(i, i + 1) for i in range(n - 1)],
        "random chain": list(zip(names[:-1], names[1:])),
        "star": [(0, i) for i in range(1, n)],
        "star with the largest inside": [(n, i) for i in range(n)],
        "comb": [(i, i + 1) for i in range(0, n // 2)] + [(i, i + n) for i in range(n // 2)],
        "ring": [(i, (i + 1) % n) for i in range(n)],
    }


@pytest.mark.parametrize("name", graphs(3))
def test_rounds(spark, name):
    edges = spark.createDataFrame(graphs(10_000)[name], "left long, right long")
    steps = split.contracted(edges)
    assert 1 <= len(steps) <= 16
    left = [s.count() for s in steps]
    assert all(2 * b <= a + 4 for a, b in zip(left[:-2], left[2:])), left  # a star may wait for the second round


def test_labels_are_the_smallest_nodes(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1300)] + [(5, 5), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in split.components(spark.createDataFrame(edges, "left long, right long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_names_of_any_type(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "left string, right string")
    assert {tuple(r) for r in split.components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    pairs = edges.select(F.struct(F.col("left").alias("n"), F.lit(1).alias("k")).alias("left"), F.struct(F.col("right").alias("n"), F.lit(1).alias("k")).alias("right"))
    assert {(r[0][0], r[1][0]) for r in split.components(pairs).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert split.components(edges.limit(0)).collect() == []
