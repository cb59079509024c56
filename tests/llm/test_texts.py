from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import leakage, lookalikes, mixing

PAIRS = [
    ("file", "ﬁle"),
    ("Café au lait", "Café au lait"),
    ("plain text", "ｐlain　text"),
    ("space here", "space here"),
    ("peace", "реасе"),
    ("zero", "ze​ro﻿"),
    ("Tower", "Τower"),
    ("é", "е́"),
    ("office", "oﬃce"),
    ("Ångström", "Ångström"),
]
APART = [("resume", "résumé"), ("10", "1０0"), ("Case", "case"), ("x2", "x²"), ("half", "½half"), ("a b", "ab"), ("strasse", "straße")]


def test_forms():
    r = lookalikes.Rewriter(lookalikes.count_strings([x for p in PAIRS + APART for x in p]))
    for a, b in PAIRS:
        assert r(a) == r(b), (a, b)
        assert r(r(b)) == r(b)
    for a, b in APART:
        assert r(a) != r(b), (a, b)
    assert r("") == ""


def test_the_frequent_form_represents():
    r = lookalikes.Rewriter(lookalikes.count_strings(["ааааа a", "е́"]))
    assert r("a") == "а" and r(r("á")) == r("á")


def test_pairs_of_documents(spark):
    rng = random.Random(1)
    texts = [rng.choice([a, b]) for a, b in PAIRS for _ in range(4)] + [a for a, _ in APART] + ["", None, "x" * 50_000, "same", "same"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "c")], "doc_id long, text string, form string")
    r = lookalikes.rewriter_for(df)
    found = [tuple(x) for x in lookalikes.lookalike_pairs(lookalikes.fingerprints(df, "doc_id", "text", r), "doc_id").collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and r(a) == r(b)}
    forms = {x.doc_id: x.t for x in df.select("doc_id", lookalikes.consistent(F.col("text"), r).alias("t")).collect()}
    assert all(forms[i] == (None if t is None else r(t)) for i, t in enumerate(texts))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lookalikes.lookalike_pairs(lookalikes.fingerprints(empty, "doc_id", "text", lookalikes.rewriter_for(empty)), "doc_id").collect() == []


def test_alignment_agrees_with_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        first, last, equal = leakage.align(a, b)
        assert (first == last) == (h.max() == 0) and 0 <= equal <= last - first
        assert equal - (last - first - equal) <= h.max() + (last - first)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(50) for i in range(12)}
    docs, truth = {}, set()
    for d in range(150):
        body = text(rng.randrange(40, 160))
        if d % 3 == 0:
            i, n = rng.randrange(12), rng.choice([8, 12, 26, 35, 50])
            at = rng.randrange(50 - n + 1)
            passage = items[i][at : at + n]
            if d % 4 == 1:
                rng.shuffle(passage)
            elif n >= 26:
                passage[n // 2] = "other"
                if d % 2:
                    del passage[n // 3]
                truth.add((d, i))
            cut = rng.randrange(len(body))
            body = body[:cut] + passage + body[cut:]
        s = " ".join(body)
        docs[d] = s.upper().replace("A", "А") if d % 7 == 0 else s.replace(" ", ",  ", 3)
    return docs, {i: " ".join(w) for i, w in items.items()}, truth


@pytest.mark.parametrize("block", [1 << 20, 1_500])
def test_leaks(spark, block):
    docs, items, truth = corpus()
    d = spark.createDataFrame([(k, v, "x") for k, v in docs.items()] + [(900, None, "x"), (901, "", "x"), (None, docs[0], "x"), (0, docs[0], "x"), (902, "w " * 30_000, "x")], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(k, v) for k, v in items.items()] + [(77, None), (78, ""), (79, "!?")], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in leakage.leaks(d, i, parameters=leakage.LeakParameters(block=block)).collect()]
    assert len(found) == len(set(found)) and set(found) == truth
    assert leakage.leaks(d.limit(0), i).collect() == [] and leakage.leaks(d, i.limit(0)).collect() == []


def test_words_forget_looks():
    assert leakage.words("Café  ​ТОР-ﬁne!") == ["cafe", "top", "fine"] and leakage.words(None) == []


def sizes(spark, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), rng.randrange(0, 40)) for i in range(1500)] + [(9000, None, 5), (9001, "unknown", 5)]
    targets = [("big", 0.5, 1), (" MID ", 0.3, 2), ("small", 0.2, 4), ("absent", None, 3), (None, 0.3, 1)]
    return rows, spark.createDataFrame(rows, "key long, source string, tokens long"), spark.createDataFrame(targets, "source string, weight double, max_repeats int")


@pytest.mark.parametrize("bucket", [37, 50_000])
@pytest.mark.parametrize("budget", [None, 6_000, 10**9])
def test_mix(spark, bucket, budget):
    rows, df, targets = sizes(spark)
    found = mixing.mix(df, targets, budget=budget, bucket_rows=bucket).collect()
    limit = {"big": 1, "mid": 2, "small": 4}
    weight = {"big": 0.5, "mid": 0.3, "small": 0.2}
    total = {s: sum(t for _, x, t in rows if x == s) for s in limit}
    uses: dict = {}
    for r in found:
        uses.setdefault(r.key, []).append(r.copy)
    assert all(sorted(c) == list(range(len(c))) and len(c) <= limit[rows[k][1]] for k, c in uses.items())
    got = {s: sum(r.tokens for r in found if r.source == s) for s in limit}
    if budget == 10**9:
        assert got == {s: total[s] * limit[s] for s in limit}
    else:
        whole = sum(got.values())
        assert whole <= (budget or 10**12)
        assert all(abs(got[s] / whole - weight[s]) < 0.02 for s in limit)
        order = sorted(found, key=lambda r: (r.finish, r.source, r.key, r.copy))
        running = 0
        for r in order:
            running += r.tokens
            assert r.position == running
    if budget:
        assert sum(got.values()) > min(budget, sum(total[s] * limit[s] for s in limit)) - 60


def test_mix_of_nothing_and_sizes(spark):
    _, df, targets = sizes(spark)
    assert mixing.mix(df.limit(0), targets).collect() == [] and mixing.mix(df, targets.limit(0)).collect() == []
    docs = spark.createDataFrame([(1, " Chat ", "hello world"), (1, " Chat ", "hello world"), (2, "chat", None), (3, None, ""), (None, "chat", "x")], "doc_id long, source string, text string")
    assert {tuple(r) for r in mixing.sized(docs).collect()} == {(1, "chat", 2), (2, "chat", 0), (3, None, 0)}
    report = {r.source: r for r in mixing.shares(mixing.mix(df, targets, budget=6000), targets).collect()}
    assert report["absent"].tokens == 0 and abs(report["mid"].share - 0.3) < 0.02
