"""Merging overlapping intervals into periods and listing the gaps between them.

The aggregate of an entity is its sorted list of disjoint intervals. Raw rows are
sorted once, where they are read; from then on lists are only merged, in time linear
in their length: inside each input partition, then across partitions. An entity whose
partial lists are still long is cut at quantiles of its starts into segments that are
merged by different tasks in a tree, over as many rounds as the number of partial
lists asks for; only the first and last interval of each segment are then stitched
together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.runtime import materialize

EVER, FOREVER = -(2**63), 2**63 - 1
_ROWS = 200_000


def _folded(group: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, end) of each disjoint interval of rows in order of group and start; touching ones become one."""
    if not len(s):
        return np.zeros(0, dtype=np.int64), e
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    # the end reached so far within a group: a running maximum over ends lifted group by group
    reach = pd.Series(e).groupby(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s)))), sort=False).cummax().to_numpy()
    new = np.ones(len(s), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (s[1:] > reach[:-1])
    starts = np.flatnonzero(new)
    return starts, reach[np.append(starts[1:], len(s)) - 1]


def _list(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Raw rows to one sorted list of disjoint intervals for each group."""
    pdf = pdf.sort_values([*by, "s"], kind="stable", ignore_index=True)
    group = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    starts, ends = _folded(group, pdf["s"].to_numpy(), pdf["e"].to_numpy())
    out = pdf.iloc[starts].reset_index(drop=True)
    out["e"] = ends
    return out


def _merge(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Sorted lists, one after the other, to one list for each group."""
    if len(pdf) < 2:
        return pdf
    group = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(group, kind="stable")
    group, s, e = group[order], pdf["s"].to_numpy()[order], pdf["e"].to_numpy()[order]
    # within a group several lists follow each other where starts fall
    falls = np.flatnonzero((group[1:] == group[:-1]) & (s[1:] < s[:-1]))
    if len(falls):
        several = np.unique(group[falls])
        for low, high in zip(np.searchsorted(group, several), np.searchsorted(group, several, "right")):
            # numpy's stable sort of integers finds the sorted runs and merges them: linear for two lists
            at = low + np.argsort(s[low:high], kind="stable")
            order[low:high], s[low:high], e[low:high] = order[at], s[at], e[at]
    starts, ends = _folded(group, s, e)
    out = pdf.iloc[order[starts]].reset_index(drop=True)
    out["e"] = ends
    return out


def _partial(by: list[str], slot: bool):
    """Merge what a partition holds; passes lists on when they grow long. ``slot``: rows are raw, lists get their partition's number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId()
        parts, rows = [], 0

        def out() -> pd.DataFrame:
            return _merge(pd.concat(parts, ignore_index=True), by)

        for pdf in batches:
            if len(pdf):
                parts.append(_list(pdf, by) if slot else pdf)
                rows += len(parts[-1])
            if rows > _ROWS:
                merged = out()
                if len(merged) > _ROWS // 2:
                    yield merged.assign(slot=at) if slot else merged
                    parts, rows = [], 0
                else:
                    parts, rows = [merged], len(merged)
        if rows:
            yield out().assign(slot=at) if slot else out()

    return run


def _last(stitch: bool):
    """Last merge of a (key, seg), whose rows stand together: rows of kind p(eriod), g(ap) and, of segments that must be stitched, e(dge)."""

    def pieces(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf = _merge(pdf, ["key", "seg"])
        key, seg = pdf["key"].to_numpy(), pdf["seg"].to_numpy()
        same = (key[1:] == key[:-1]) & (seg[1:] == seg[:-1])
        gaps = pd.DataFrame({"key": key[1:][same], "seg": seg[1:][same], "kind": "g", "s": pdf["e"].to_numpy()[:-1][same], "e": pdf["s"].to_numpy()[1:][same]})
        edge = ~np.append(False, same) | ~np.append(same, False) if stitch else np.zeros(len(pdf), dtype=bool)
        yield gaps
        yield pdf.assign(kind=np.where(edge, "e", "p"))[["key", "seg", "kind", "s", "e"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b[["key", "seg", "s", "e"]])
            rows += len(b)
            if rows > _ROWS:
                # all but the last (key, seg), of which more may follow
                whole = pd.concat(held, ignore_index=True)
                key, seg = whole["key"].to_numpy(), whole["seg"].to_numpy()
                cut = int(np.flatnonzero((key != key[-1]) | (seg != seg[-1])).max(initial=-1)) + 1
                if cut:
                    yield from pieces(whole.iloc[:cut].reset_index(drop=True))
                    held, rows = [whole.iloc[cut:]], len(whole) - cut
                else:
                    held = [_merge(whole, ["key", "seg"])]
                    rows = len(held[0])
        if held:
            yield from pieces(pd.concat(held, ignore_index=True))

    return run


def merged_intervals(df: DataFrame, key: str | Column, start: str | Column, end: str | Column, *, segment_rows: int = 100_000, fan_in: int = 16) -> DataFrame:
    """Continuous periods and the gaps between them, of each key.

    :param start: first microsecond (timestamp or long) held; null means since ever.
    :param end: first microsecond no longer held; null means for ever.
    :param segment_rows: rows of partial lists from which an entity is split.
    :param fan_in: partial lists that one merge of a split entity's segment takes in.
    :return: key, kind (``period`` or ``gap``), start_us, end_us, where null marks an
        open side. Rows with a null key, and intervals whose end isn't after their
        start, are ignored; touching and repeated intervals merge. The times before
        the first and after the last period are no gaps. Empty in, empty out.
    """
    key, start, end = (F.col(x) if isinstance(x, str) else x for x in (key, start, end))

    def micros(c: Column, name: str) -> Column:
        return (F.unix_micros(c.cast("timestamp")) if dict(df.select(c.alias("x")).dtypes)["x"].startswith("timestamp") else c.cast("long")).alias(name)

    rows = df.select(key.alias("key"), micros(start, "s"), micros(end, "e")).filter(F.col("key").isNotNull())
    rows = rows.select("key", F.coalesce("s", F.lit(EVER)).alias("s"), F.coalesce("e", F.lit(FOREVER)).alias("e")).filter("s < e")
    kind_of_key = rows.schema["key"].dataType.simpleString()
    plain = f"key {kind_of_key}, s long, e long, slot int"
    partial = materialize(rows.mapInPandas(_partial(["key"], True), plain), "intervals")

    heavy = partial.groupBy("key").agg(F.count("*").alias("n"), F.max("slot").alias("top")).filter(F.col("n") > segment_rows)
    found, most, slots = heavy.agg(F.count("*"), F.max("n"), F.max("top") + 1).first()

    pieces = "key {0}, seg int, kind string, s long, e long".format(kind_of_key)
    if not found:
        done = partial.select("key", F.lit(0).alias("seg"), "s", "e").repartition("key").sortWithinPartitions("key").mapInPandas(_last(False), pieces)
        return _output(done)

    # every segment gets about segment_rows of the partial rows: cuts for the largest entity, thinned out for the others
    q = -(-most // segment_rows)
    step = F.greatest(F.lit(1), F.floor(q * segment_rows / F.col("n"))).cast("int")
    cuts = partial.join(heavy.select("key", "n"), "key").groupBy("key", "n").agg(F.percentile_approx("s", [x / q for x in range(1, q)], 100 * q).alias("cuts"))
    cuts = cuts.select("key", F.array_sort(F.array_distinct(F.filter("cuts", lambda x, i: (i + 1) % step == 0))).alias("cuts"))
    marked = partial.join(cuts, "key", "left")
    light = marked.filter("cuts is null").select("key", F.lit(0).alias("seg"), "s", "e").repartition("key").sortWithinPartitions("key").mapInPandas(_last(False), pieces)
    inner = F.filter("cuts", lambda x: (x > F.col("s")) & (x < F.col("e")))
    starts, ends = F.concat(F.array("s"), inner), F.concat(inner, F.array("e"))
    first = F.size(F.filter("cuts", lambda x: x <= F.col("s")))
    split = marked.filter("cuts is not null").select("key", "slot", first.alias("first"), F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("i", "x"))
    split = split.select("key", (F.col("first") + F.col("i")).cast("int").alias("seg"), F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("slot").cast("int").alias("slot"))
    while slots > fan_in:
        slots = -(-slots // fan_in)
        split = split.withColumn("slot", F.floor(F.col("slot") / fan_in).cast("int")).repartition("key", "seg", "slot")
        split = split.mapInPandas(_partial(["key", "seg", "slot"], False), f"key {kind_of_key}, seg int, s long, e long, slot int")
    parts = split.repartition("key", "seg").sortWithinPartitions("key", "seg").mapInPandas(_last(True), pieces)
    # stitching: two rows a segment, so few rows a key
    edges, w = parts.filter("kind = 'e'"), Window.partitionBy("key").orderBy("s")
    edges = edges.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.lag("seg").over(w))
    between = edges.filter((F.col("s") > F.col("reach")) & (F.col("before") != F.col("seg"))).select("key", "seg", F.lit("g").alias("kind"), F.col("reach").alias("s"), F.col("s").alias("e"))
    island = F.sum(F.when(F.col("s") > F.col("reach"), 1).otherwise(0)).over(w)
    stitched = edges.withColumn("island", island).groupBy("key", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    stitched = stitched.select("key", F.lit(0).alias("seg"), F.lit("p").alias("kind"), "s", "e")
    return _output(light.unionByName(parts.filter("kind <> 'e'")).unionByName(between).unionByName(stitched))


def _output(rows: DataFrame) -> DataFrame:
    return rows.select(
        "key",
        F.when(F.col("kind") == "g", "gap").otherwise("period").alias("kind"),
        F.when(F.col("s") != EVER, F.col("s")).alias("start_us"),
        F.when(F.col("e") != FOREVER, F.col("e")).alias("end_us"),
    )
