"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.runtime import materialize


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    if parent:
        yield pd.DataFrame({"u": [find(x) for x in parent], "v": list(parent)})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 60, task_edges: int = 200_000) -> DataFrame:
    """(node, component): component is the least node it is connected with.

    Up to ``task_edges`` edges in all are solved by union-find in one task. Beyond,
    every round is two aggregations by node and no component is gathered in a task.
    Rows with a null end are no edges; self-loops make a node its own component.
    Raises if ``max_rounds`` (far above log n of any input) does not suffice.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    every = materialize(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc0")
    nodes = every.select(F.col("u").alias("node")).unionByName(every.select(F.col("v").alias("node"))).distinct()
    links = every.filter("u <> v")
    if links.count() <= task_edges:
        links, max_rounds = links.coalesce(1).mapInPandas(_union_find, links.schema), 0
    before = None
    for i in range(max_rounds):
        # large star: a node hands its larger neighbours to its least neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # small star: a node hands itself and its smaller neighbours to the least one
        low = star.groupBy("v").agg(F.min("u").alias("m"))
        own = low.select(F.col("m").alias("u"), "v")
        rest = star.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).filter("u <> v")
        links = materialize(own.unionByName(rest).distinct(), f"cc{i + 1}")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        if max_rounds:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return nodes.join(links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
