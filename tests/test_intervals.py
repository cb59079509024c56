from __future__ import annotations

import random

import pytest

from engram.operators.intervals import merged_intervals


def brute(rows):
    by = {}
    for k, s, e in rows:
        if k is None:
            continue
        s, e = -(2**63) if s is None else s, 2**63 - 1 if e is None else e
        if s < e:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, v in by.items():
        v.sort()
        merged = [list(v[0])]
        for s, e in v[1:]:
            if s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            out.add((k, "period", None if s == -(2**63) else s, None if e == 2**63 - 1 else e))
        for a, b in zip(merged, merged[1:]):
            out.add((k, "gap", a[1], b[0]))
    return out


@pytest.mark.parametrize("segment", [5, 40, 100_000])
def test_agrees_with_sorting(spark, segment):
    rng = random.Random(segment)
    rows = []
    for i in range(900):
        k = rng.choice(["hot"] * 5 + ["a", "b", None])
        s = rng.randrange(4000) if rng.random() > 0.01 else None
        e = (s or 0) + rng.randrange(-3, 9) if rng.random() > 0.005 else None
        rows.append((k, s, e))
    df = spark.createDataFrame(rows, "key string, s long, e long").repartition(20)
    found = [tuple(r) for r in merged_intervals(df, "key", "s", "e", segment_rows=segment, fan_in=3).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_touching_nested_repeated_and_long(spark):
    rows = [("a", 1, 5), ("a", 5, 7), ("a", 2, 3), ("a", 1, 5), ("a", 9, 9), ("a", 12, 10), ("a", 20, 30), ("b", None, None), ("b", 3, 4)]
    df = spark.createDataFrame(rows, "key string, s long, e long")
    assert {tuple(r) for r in merged_intervals(df, "key", "s", "e").collect()} == {("a", "period", 1, 7), ("a", "gap", 7, 20), ("a", "period", 20, 30), ("b", "period", None, None)}


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "key string, seg int, slot int, valid_from timestamp, valid_until timestamp")
    assert merged_intervals(df, "key", "valid_from", "valid_until").collect() == []
