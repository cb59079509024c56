from __future__ import annotations

import random

import pytest

from engram.operators.components import connected_components
from engram.operators.running import running_sum
from pyspark.sql import functions as F


@pytest.mark.parametrize("task_edges", [0, 200_000])
def test_components(spark, task_edges):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(None, 3), (5, None), (900, 900)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), task_edges=task_edges)
    assert {tuple(r) for r in found.collect()} == {(x, find(x)) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_running_sum(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.random(), rng.randrange(5) if rng.random() > 0.1 else None) for _ in range(300)]
    df = running_sum(spark.createDataFrame(rows, "g string, x double, v long"), "v", ["g"], F.floor(F.col("x") * 7), [F.col("x")])
    expected, total = {}, {}
    for g, x, v in sorted(rows, key=lambda r: r[1]):
        total[g] = total.get(g, 0) + (v or 0)
        expected[g, x] = total[g]
    assert {(r.g, r.x): r.running for r in df.collect()} == expected
