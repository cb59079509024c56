from __future__ import annotations

import random

import pytest

from engram.operators.hierarchy import CYCLE, _heads, descendants, hierarchy


def brute(parent: dict[str, str]) -> dict[str, tuple[str, int, list[str] | None]]:
    out = {}
    for node in parent:
        path, at, seen = [], node, {node}
        while at in parent:
            at = parent[at]
            if at in seen:
                path = None
                break
            seen.add(at)
            path.append(at)
        if path is None:
            out[node] = (CYCLE, -1, None)
        else:
            out[node] = (path[-1], len(path), path)
    return out


def shapes():
    rng = random.Random(3)
    chain = {f"n{i}": f"n{i + 1}" for i in range(300)}
    star = {f"n{i}": "hub" for i in range(300)} | {"hub": "top"}
    wild = {f"n{i}": f"n{rng.randrange(250)}" for i in range(220)}
    late = {f"n{i}": f"n{rng.randrange(i)}" for i in range(1, 260)}
    loops = {"a": "a", "b": "c", "c": "b", "d": "b", "e": "f"}
    # more nodes on cycles than a fragment holds, and trees below them
    rings = {f"r{i}": f"r{i - 2 if i % 3 == 2 else i + 1}" for i in range(150)} | {f"t{i}": f"r{i}" if i < 40 else f"t{i - 40}" for i in range(100)}
    return {"chain": chain, "star": star, "wild": wild, "late": late, "loops": loops, "rings": rings}


@pytest.mark.parametrize("name", shapes())
@pytest.mark.parametrize("size", [20, 100_000])
def test_agrees_with_following_each_pointer(spark, name, size):
    parent = shapes()[name]
    found = hierarchy(spark.createDataFrame(list(parent.items()), "node string, parent string").repartition(4), with_path=True, fragment_rows=size).collect()
    assert {r.node: (r.root, r.depth, r.path) for r in found} == brute(parent)


def test_nulls_repeats_clashing_columns_and_several_parents(spark):
    rows = [("a", "b", "x", 1), ("a", "b", "y", 2), ("b", "z", None, 3), ("b", "c", None, 4), (None, "b", "n", 5), ("q", None, "n", 6)]
    df = spark.createDataFrame(rows, "node string, parent string, root string, depth int")
    assert {tuple(r) for r in hierarchy(df).collect()} == {("a", "c", 2), ("b", "c", 1)}


def test_empty(spark):
    df = spark.createDataFrame([], "node string, parent string")
    assert hierarchy(df).collect() == []
    assert descendants(hierarchy(df, with_path=True)).collect() == []


def test_descendants(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "b"), ("x", "x")], "node string, parent string")
    found = {tuple(r) for r in descendants(hierarchy(df, with_path=True)).collect()}
    assert found == {("b", "a", 1), ("c", "a", 2), ("c", "b", 1), ("b", "d", 1), ("c", "d", 2)}


@pytest.mark.parametrize("name", ["loops", "wild"])
def test_descendants_on_and_below_cycles(spark, name):
    parent = shapes()[name] | {"x": "y", "y": "z", "z": "w", "w": "z", "self": "self", "under": "self"}
    expected = set()
    for node in parent:
        at, seen = parent[node], [node]
        while at not in seen:
            expected.add((at, node, len(seen)))
            seen.append(at)
            at = parent.get(at, node)
    df = spark.createDataFrame(list(parent.items()), "node string, parent string").repartition(4)
    found = [tuple(r) for r in descendants(hierarchy(df, with_path=True, around=True)).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert {("y", "x", 1), ("z", "x", 2), ("w", "x", 3), ("self", "under", 1)} <= expected


@pytest.mark.parametrize("size", [2, 100_000])
def test_each_cycle_has_one_head(spark, size):
    links = [("x", "y"), ("y", "z"), ("z", "w"), ("w", "z"), ("self", "self"), ("under", "self"), ("c", "a"), ("a", "b"), ("b", "c"), ("0", "b")]
    assert sorted(r.head for r in _heads(spark.createDataFrame(links, "node string, parent string"), size).collect()) == ["a", "self", "w"]
