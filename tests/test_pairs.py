from __future__ import annotations

import pytest

from engram.operators.pairs import blocked_join


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocked_join_is_an_inner_join(spark, block):
    a = spark.createDataFrame([("hot", i) for i in range(40)] + [("cold", 1), ("alone", 2), (None, 3), ("hot", 5)], "k string, x int")
    b = spark.createDataFrame([("hot", i) for i in range(25)] + [("cold", 9), (None, 3), ("cold", 9)], "k string, y int")
    key = lambda r: (r.k, r.x, r.y)
    assert sorted(map(key, blocked_join(a, b, ["k"], block=block).collect())) == sorted(map(key, a.join(b, "k").collect()))
    assert blocked_join(a.limit(0), b, ["k"]).collect() == []
