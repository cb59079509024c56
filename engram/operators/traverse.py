"""Walks over an edge table, hop by hop, with a visited set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.runtime import materialize


def walk(edges: DataFrame, seeds: DataFrame | None, low: int, high: int | None) -> DataFrame:
    """Distinct (start, end, depth) with the least depth, for depths from low to high.

    :param edges: src, dst (strings). Nodes without outgoing edges end a walk.
    :param seeds: start (distinct starts); null: every node with an outgoing edge.
    A start itself counts at depth 0 only; a node reached in fewer hops than ``low``
    isn't reported for a longer way. Each hop shuffles the frontier once; the
    visited pairs are the result itself. A walk without ``high`` ends when a hop finds
    nothing new, however many hops that takes. The visited pairs lie in parts that are
    merged as they become many, so plans stay small on long chains.
    """
    steps = materialize(edges.select("src", "dst").dropna().distinct(), "edges")
    starts = steps.select(F.col("src").alias("start")) if seeds is None else seeds.select("start").filter("start is not null")
    frontier = materialize(starts.distinct().select("start", F.col("start").alias("end"), F.lit(0).alias("depth")), "walk")
    parts, depth = [(0, frontier)], 0
    while high is None or depth < high:
        depth += 1
        step = frontier.select("start", F.col("end").alias("src")).join(steps, "src").select("start", F.col("dst").alias("end")).distinct()
        seen = reduce(DataFrame.unionByName, [p for _, p in parts])
        frontier = materialize(step.join(seen.select("start", "end"), ["start", "end"], "left_anti").withColumn("depth", F.lit(depth)), "walk")
        if frontier.isEmpty():
            break
        parts.append((0, frontier))
        # four parts of a level become one of the next
        while len(parts) >= 4 and len({level for level, _ in parts[-4:]}) == 1:
            level = parts[-1][0] + 1
            merged = materialize(reduce(DataFrame.unionByName, [p for _, p in parts[-4:]]), "walk")
            parts[-4:] = [(level, merged)]
    return reduce(DataFrame.unionByName, [p for _, p in parts]).filter(F.col("depth") >= low)
