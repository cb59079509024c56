"""Mixing sources to target shares of the tokens, by weighted fair queueing.

Each source's documents are shuffled, once for every time the source is used.
A document's virtual finish time is the running sum of its source's tokens up to
and with it, divided by the source's weight; taking documents in order of finish
time serves every source in proportion to its weight at any point. The order is
made globally by ranges and cut at the budget.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.running import running_sum
from engram.runtime import materialize

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str):
    """The public tokenizer of the ranks: lines of a base64 token and its number."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines())}, special_tokens={})


def sized(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = DEFAULT_RANKS) -> DataFrame:
    """(key, source, tokens): source trimmed and in lower case; null texts have 0 tokens. Rows of one key count once.

    The ranks, a file of about a megabyte, are read by the driver and sent to the executors.
    """
    import public_tokenizers

    with open(tokenizer, "rb") as f:
        known = docs.sparkSession.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(*known.value)
        for pdf in batches:
            if not len(pdf):
                continue
            n = [len(e.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "source": pdf["source"], "tokens": n})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.lower(F.trim(source)).alias("source"), F.col(text).alias("text")).filter("key is not null")
    return rows.mapInPandas(run, f"key {kind}, source string, tokens long").groupBy("key").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def level(totals: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None) -> tuple[float, float]:
    """(virtual time at which the budget is used up, budget).

    Without a budget it is the most at which every source still meets its share.
    """
    live = {s: (w, totals.get(s, 0) * r) for s, (w, r) in targets.items() if w > 0}
    present = {s: x for s, x in live.items() if x[1] > 0}
    if not present:
        return 0.0, 0.0
    if budget is None:
        v = min(cap / w for w, cap in live.values()) if len(present) == len(live) else min(cap / w for w, cap in present.values())
        return v, sum(min(w * v, cap) for w, cap in present.values())
    rest, at, used = dict(present), 0.0, 0.0
    while rest:
        rate = sum(w for w, _ in rest.values())
        step = min(cap / w for w, cap in rest.values())
        if used + rate * (step - at) >= budget:
            return at + (budget - used) / rate, budget
        used, at = used + rate * (step - at), step
        rest = {s: x for s, x in rest.items() if x[1] / x[0] > step}
    return at, used


def mix(sizes: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 7, bucket_rows: int = 50_000) -> DataFrame:
    """The chosen records: key, copy (0 first), source, tokens, finish (virtual time), position (running tokens).

    :param sizes: key, source, tokens. Sources without a target are left out.
    :param targets: source, weight, max_repeats: a bounded table, one row a source; it
        is read by the driver. Sources with a null or no weight are left out.
    :param budget: total tokens; the result ends before the record that would exceed it.
        Null: the most with which every source can meet its share. Sources used up
        before leave their part to the others.
    """
    wanted = {r.source: (float(r.weight), int(r.max_repeats if r.max_repeats is not None else 1)) for r in targets.select(F.lower(F.trim("source")).alias("source"), "weight", "max_repeats").collect() if r.source is not None and r.weight and r.weight > 0}
    spark = sizes.sparkSession
    empty = lambda: sizes.select("key", F.lit(0).alias("copy"), "source", "tokens", F.lit(0.0).alias("finish"), F.lit(0).cast("long").alias("position")).limit(0)
    if not wanted:
        return empty()
    own = sizes.filter(F.col("source").isin(*wanted))
    sums = {r.source: (r.t or 0, r.n, r.most or 0) for r in own.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("tokens").alias("most")).collect()}
    totals = {s: t for s, (t, _, _) in sums.items()}
    stop, total = level(totals, wanted, budget)
    if total <= 0:
        return empty()
    # at this time at least the total is served even if every source lags by its longest document, so nothing behind it is chosen
    latest, _ = level(totals, wanted, total + sum(most for _, _, most in sums.values()) + 1)
    latest *= 1 + 1e-9
    # times a source is used: up to the one in which the last virtual time falls
    plan = [(s, w, t, max(1, -(-n // bucket_rows)), min(r, int(latest * w // t) + 1 if t else 0)) for s, (t, n, _) in sums.items() for w, r in [wanted[s]]]
    plan_df = spark.createDataFrame(plan, "source string, weight double, total long, buckets long, uses int").filter("uses > 0")
    rows = own.join(F.broadcast(plan_df), "source").select("*", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("copy"))
    place = F.pmod(F.xxhash64(F.lit(seed), "copy", "key"), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.withColumn("place", place)
    queued = running_sum(rows, "tokens", ["source", "copy"], F.floor(F.col("place") * F.col("buckets")), [F.col("place"), F.col("key")], "served")
    finish = (F.col("served") + F.col("copy") * F.col("total")) / F.col("weight")
    queued = queued.withColumn("finish", finish).select("key", "copy", "source", "tokens", "finish")
    queued = materialize(queued.filter(F.col("finish") <= latest), "queued")
    buckets = max(1, -(-2 * queued.count() // bucket_rows))
    cut = running_sum(queued, "tokens", [], F.floor(F.col("finish") / latest * buckets), [F.col("finish"), F.col("source"), F.col("key"), F.col("copy")], "position")
    return cut.filter(F.col("position") <= total).select("key", "copy", "source", "tokens", "finish", F.col("position").cast("long").alias("position"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target, records, most copies of a record, tokens and the share reached."""
    by = mixed.groupBy("source").agg(F.count("*").alias("records"), (F.max("copy") + 1).alias("most_copies"), F.sum("tokens").alias("tokens"))
    by = by.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))  # one row a source
    rows = targets.select(F.lower(F.trim("source")).alias("source"), F.col("weight").alias("target")).join(by, "source", "left")
    return rows.select("source", "target", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"))
