"""Parent-child links to full hierarchies, by fragment contraction.

Each partition contracts its own parent chains to the point where they leave the
partition (the exit). Only nodes that other fragments' chains arrive at remain,
with one edge each from entry to exit: the quotient forest, which is solved the
same way until one bounded fragment holds it. Solutions are then expanded level
by level. Leaves vanish in the first contraction, so the quotient holds inner
nodes only; from then on a random-mate placement (a "tail" node joins the
fragment of its "head" parent, by coins tossed anew at each level) makes sure that
about a quarter of all edges is local whatever the shape, chains included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.runtime import materialize

CYCLE = "(cycle)"


def _contract(pdf: pd.DataFrame, with_path: bool) -> pd.DataFrame:
    """Follow parents inside one fragment; columns node, parent, steps, looped[, path]."""
    n = len(pdf)
    index = pd.Index(pdf["node"])
    parent = pdf["parent"].to_numpy(dtype=object)
    looped = pdf["looped"].to_numpy(dtype=bool)
    first = index.get_indexer(pd.Index(parent))
    first[looped] = -1
    jump, last = first.copy(), np.arange(n)
    steps, hops = pdf["steps"].to_numpy(dtype=np.int64).copy(), np.ones(n, dtype=np.int64)
    for _ in range(max(1, int(np.ceil(np.log2(n + 1))) + 1)):
        live = np.flatnonzero(jump >= 0)
        if not len(live):
            break
        to = jump[live]
        steps[live], hops[live], last[live], jump[live] = steps[live] + steps[to], hops[live] + hops[to], last[to], jump[to]
    endless = jump >= 0
    out = pd.DataFrame({"node": pdf["node"].to_numpy(), "parent": parent[last], "steps": steps, "looped": endless | looped[last]})
    if with_path:
        own = pdf["path"].to_numpy() if "path" in pdf else [[p] for p in parent]
        paths: list = [None] * n
        closed = endless | looped[last]
        for i in np.argsort(hops, kind="stable"):
            if not closed[i]:
                paths[i] = list(own[i]) + (paths[first[i]] if first[i] >= 0 else [])
        out["path"] = paths
    return out


def _fragments(edges: DataFrame, with_path: bool, size: int) -> DataFrame:
    """Contract every partition by itself, a larger one in fragments of at least ``size`` nodes (and a batch at most more)."""
    schema = "node string, parent string, steps long, looped boolean" + (", path array<string>" if with_path else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, rows = [], 0
        for b in batches:
            if len(b):
                parts.append(b)
                rows += len(b)
            if rows >= size:
                yield _contract(pd.concat(parts, ignore_index=True), with_path)
                parts, rows = [], 0
        if parts:
            yield _contract(pd.concat(parts, ignore_index=True), with_path)

    return edges.mapInPandas(run, schema)


def _placed(edges: DataFrame, count: int, size: int, with_path: bool, level: int) -> DataFrame:
    """Spread the quotient over fragments of about ``size`` nodes by random mate, with other coins at each level.

    The children of a hot parent (more of them than a tenth of a fragment) don't gather
    with it: they are led past it to its own parent instead. There are fewer than
    10 * count / size hot parents, so their edges are broadcast.
    """
    parts = -(-2 * count // size)
    hot = edges.groupBy("parent").count().filter(F.col("count") > max(1, size // 10)).select(F.col("parent").alias("node"))
    hubs = edges.join(hot, "node", "left_semi").select(F.col("node").alias("parent"), F.col("parent").alias("_to"), F.col("steps").alias("_more"), F.col("looped").alias("_looped"), *([F.col("path").alias("_rest")] if with_path else []))
    past = edges.join(F.broadcast(hubs), "parent", "left")
    led = F.col("_to").isNotNull() & ~F.col("looped") & (F.col("parent") != F.col("node"))
    columns = [
        "node",
        F.when(led, F.col("_to")).otherwise(F.col("parent")).alias("parent"),
        F.when(led, F.col("steps") + F.col("_more")).otherwise(F.col("steps")).alias("steps"),
        (F.col("looped") | led & F.col("_looped")).alias("looped"),
    ]
    if with_path:
        columns.append(F.when(led, F.concat("path", "_rest")).otherwise(F.col("path")).alias("path"))
    past = past.select(*columns)
    head = lambda c: F.xxhash64(F.lit("coin"), F.lit(level), c) % 2 == 0
    home = F.when(~head(F.col("node")) & head(F.col("parent")), F.col("parent")).otherwise(F.col("node"))
    return past.withColumn("home", home).repartition(parts, F.lit(level), "home").drop("home")


def _solve(edges: DataFrame, size: int, with_path: bool, level: int) -> DataFrame:
    """(node, parent=root, steps=depth, looped[, path]) for edges placed in partitions."""
    cut = materialize(_fragments(edges, with_path, size), f"forest{level}")
    # what a looped node points to is of no more interest
    entries = cut.filter(~F.col("looped")).select(F.col("parent").alias("node")).distinct()
    quotient = cut.join(entries, "node", "left_semi")
    if level:
        quotient = materialize(quotient, f"quotient{level}")
    count = quotient.count()
    if not count:
        return cut
    if count <= size:
        solved = _fragments(quotient.coalesce(1), with_path, count + 1)
    else:
        solved = _solve(_placed(quotient, count, size, with_path, level), size, with_path, level + 1)
    above = solved.select(F.col("node").alias("parent"), F.col("parent").alias("root"), F.col("steps").alias("more"), F.col("looped").alias("endless"), *([F.col("path").alias("rest")] if with_path else []))
    joined = cut.join(above, "parent", "left")
    looped = F.col("looped") | F.coalesce("endless", F.lit(False))
    columns = [
        F.col("node"),
        F.coalesce("root", "parent").alias("parent"),
        (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
        looped.alias("looped"),
    ]
    if with_path:
        columns.append(F.when(~looped, F.concat("path", F.coalesce("rest", F.array().cast("array<string>")))).alias("path"))
    return joined.select(*columns)


def _jumped(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of endless ways to a place on their cycle and the least node met; columns node, parent."""
    names = np.sort(pdf["node"].to_numpy(dtype=object))
    index = pd.Index(names)
    own = index.get_indexer(pd.Index(pdf["node"]))
    at, least = np.empty(len(names), dtype=np.int64), np.arange(len(names))
    at[own] = index.get_indexer(pd.Index(pdf["parent"]))
    for _ in range(max(1, len(names).bit_length())):
        least, at = np.minimum(least, least[at]), at[at]
    return pd.DataFrame({"node": names, "at": names[at], "least": names[least]})


def _heads(endless: DataFrame, size: int) -> DataFrame:
    """(head) the least node of every cycle, of (node, parent) whose ways up never end.

    After at least as many steps as there are nodes every node has arrived on its
    cycle, and every node of a cycle is arrived at. Steps double from round to round.
    """
    inner = materialize(endless.join(endless.select(F.col("parent").alias("node")).distinct(), "node", "left_semi"), "inner")
    count = inner.count()
    if count <= size:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [b for b in batches if len(b)]
            if parts:
                yield _jumped(pd.concat(parts, ignore_index=True))

        jumped = materialize(inner.coalesce(1).mapInPandas(run, "node string, at string, least string"), "jumped")
    else:
        jumped = inner.select("node", F.col("parent").alias("at"), F.col("node").alias("least"))
        for i in range(count.bit_length()):
            there = jumped.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("least").alias("other"))
            jumped = materialize(jumped.join(there, "at").select("node", F.col("to").alias("at"), F.least("least", "other").alias("least")), f"jump{i}")
    return jumped.join(jumped.select(F.col("at").alias("node")).distinct(), "node", "left_semi").filter("node = least").select(F.col("node").alias("head"))


def _around(links: DataFrame, tree: DataFrame, size: int) -> DataFrame:
    """(node, path) of the nodes whose way up never ends: up to their cycle and once round it.

    Every cycle is cut above its head, which makes a forest with the heads as roots;
    a path of it is carried on above the head up to the first node already met.
    """
    endless = materialize(links.join(tree.filter(F.col("root") == CYCLE).select("node"), "node", "left_semi").select("node", "parent"), "endless")
    heads = materialize(_heads(endless, size), "heads")
    forest = endless.join(heads.select(F.col("head").alias("node")), "node", "left_anti")
    below = materialize(hierarchy(forest, with_path=True, fragment_rows=size).select("node", F.col("root").alias("head"), "path"), "below")
    tops = heads.join(endless.select(F.col("node").alias("head"), F.col("parent").alias("next")), "head")
    ring = tops.join(below.select(F.col("node").alias("next"), F.col("path").alias("rest")), "next", "left")
    ring = ring.select("head", F.concat(F.array("next"), F.coalesce("rest", F.array().cast("array<string>"))).alias("ring"))
    paths = below.unionByName(heads.select(F.col("head").alias("node"), "head", F.array().cast("array<string>").alias("path")))
    # the ring holds the whole cycle: its first node that was met is where the way enters it
    met = F.concat(F.array("node"), "path")
    known = F.array_position("ring", F.element_at(F.array_intersect("ring", met), 1))
    return paths.join(ring, "head").select("node", F.concat("path", F.slice("ring", F.lit(1), (known - 1).cast("int"))).alias("path"))


def hierarchy(edges: DataFrame, node: str | Column = "node", parent: str | Column = "parent", *, with_path: bool = False, around: bool = False, fragment_rows: int = 250_000) -> DataFrame:
    """Path, depth and root of every node that has a parent.

    :param edges: one row per link; any further columns are ignored.
    :param with_path: add ``path``, the keys from the parent up to the root.
    :param around: with paths, give a node whose way up never ends the path up to its
        cycle and once round it, without the node itself, instead of null.
    :param fragment_rows: nodes that one task may hold.
    :return: node, root, depth[, path]; for a node whose way up never ends root is
        ``(cycle)``, depth -1 and path null. Rows with a null node or parent are no
        links; repeated links count once; of several parents the least key is taken.
        An empty input gives an empty result.
    """
    node, parent = (F.col(x) if isinstance(x, str) else x for x in (node, parent))
    links = edges.select(node.cast("string").alias("node"), parent.cast("string").alias("parent")).dropna().groupBy("node").agg(F.min("parent").alias("parent"))
    links = links.select("node", "parent", F.lit(1).cast("long").alias("steps"), F.lit(False).alias("looped"))
    found = _solve(links, fragment_rows, with_path, 0)
    tree = found.select(
        "node",
        F.when(F.col("looped"), F.lit(CYCLE)).otherwise(F.col("parent")).alias("root"),
        F.when(F.col("looped"), F.lit(-1)).otherwise(F.col("steps")).cast("long").alias("depth"),
        *(["path"] if with_path else []),
    )
    if not (with_path and around):
        return tree
    tree = materialize(tree, "tree")
    turned = _around(links, tree, fragment_rows).withColumnRenamed("path", "_turned")
    return tree.join(turned, "node", "left").select("node", "root", "depth", F.coalesce("path", "_turned").alias("path"))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for all pairs of a hierarchy with paths.

    Rows are exploded from each node's own path, so no ancestor's descendants ever
    meet in one task. Nodes on or below a cycle have pairs if the hierarchy was made
    with ``around``: each once, at its least distance, and none with themselves.
    """
    return tree.select(F.col("node").alias("descendant"), F.posexplode("path").alias("at", "ancestor")).select("ancestor", "descendant", (F.col("at") + 1).cast("long").alias("distance"))
