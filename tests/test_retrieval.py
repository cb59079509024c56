from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import bm25, hybrid, paging, vectors
from engram.operators.filters import AllOf, And, AnyOf, Between, Eq, Field, FilterError, Ge, Gt, Include, Le, Lt, NoneOf, Not, Or, compile_filter, where

ROWS = [(i, random.Random(i).choice([None, *range(16)]), [random.Random(i * 7 + j).randrange(16) for j in range(i % 4)] if i % 9 else None) for i in range(60)]


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame(ROWS, "_id long, k long, ks array<long>").cache()


def matches(q, k) -> bool:
    match q:
        case Eq(v):
            return k == v
        case Gt(v):
            return k > v
        case Ge(v):
            return k >= v
        case Lt(v):
            return k < v
        case Le(v):
            return k <= v
        case Between(a, b):
            return a <= k <= b
        case Include(vs):
            return k in vs
        case AllOf(ps):
            return bool(ps) and all(matches(p, k) for p in ps)
        case AnyOf(ps):
            return any(matches(p, k) for p in ps)
        case NoneOf(p):
            return not matches(p, k)


def holds(f, row) -> bool:
    match f:
        case Field(name, q):
            keys = [row[1]] if name == "k" else row[2] or []
            return any(matches(q, k) for k in keys if k is not None)
        case And(ps):
            return bool(ps) and all(holds(p, row) for p in ps)
        case Or(ps):
            return any(holds(p, row) for p in ps)
        case Not(p):
            return not holds(p, row)


value = st.integers(0, 18)
leaf = st.one_of(*[st.builds(c, value) for c in (Eq, Gt, Ge, Lt, Le)], st.builds(Between, value, value), st.builds(Include, st.lists(value, max_size=4).map(tuple)))
ranges = st.recursive(leaf, lambda q: st.one_of(st.builds(AllOf, st.lists(q, max_size=3).map(tuple)), st.builds(AnyOf, st.lists(q, max_size=3).map(tuple)), st.builds(NoneOf, q)), max_leaves=5)
filters = st.recursive(st.builds(Field, st.sampled_from(["k", "ks"]), ranges), lambda f: st.one_of(st.builds(And, st.lists(f, max_size=3).map(tuple)), st.builds(Or, st.lists(f, max_size=3).map(tuple)), st.builds(Not, f)), max_leaves=4)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(filters, min_size=6, max_size=6))
def test_filters_agree_with_the_model(keyed, nodes):
    found = keyed.select("_id", *[compile_filter(n, keyed.schema).alias(f"f{i}") for i, n in enumerate(nodes)]).collect()
    for row, got in zip(ROWS, sorted(found)):
        assert [got[f"f{i}"] for i in range(6)] == [holds(n, row) for n in nodes]


def test_filter_errors(keyed):
    deep = Field("k", Eq(1))
    for _ in range(70):
        deep = Not(deep)
    for bad in (Field("zz", Eq(1)), Field("k", Eq("1")), Field("k", Eq(True)), Field("k", Include(tuple(range(5000)))), deep, "k"):
        with pytest.raises(FilterError):
            where(keyed, bad)


def test_pages(keyed):
    ids = [r[0] for r in ROWS if r[1] is not None and r[1] > 4]
    node = Field("k", Gt(4))
    assert [r._id for r in paging.query_ids(keyed, node, 5).collect()] == ids[:5]
    assert [r._id for r in paging.query_last_ids(keyed, node, 5).collect()] == ids[-5:]
    assert [r._id for r in paging.query_all_ids(keyed, node).collect()] == ids
    assert paging.query_ids(keyed, node, 0).collect() == []
    assert [r.key for r in paging.keys_page(keyed, "ks", 3, 4).collect()] == sorted({k for r in ROWS for k in r[2] or [] if k > 3})[:4]
    assert [r._id for r in paging.get_many(keyed, [3, 999, 3]).collect()] == [3, None, 3]
    assert paging.search_limit(None) == 10 and paging.search_limit(5000) == 1000 and paging.candidates(1000) == 4096


DOCS = [(0, "alpha beta beta"), (1, "beta gamma"), (2, "alpha delta gamma gamma"), (3, ""), (4, None), (5, "! x ?"), (6, "delta " * 3000), (7, "alpha beta beta")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1.0) for i, t in DOCS], "_id long, text string, score double").cache()


def has(i, w):
    return w in (dict(DOCS)[i] or "").split()


@pytest.mark.parametrize(
    "query,test",
    [
        ("alpha AND beta", lambda i: has(i, "alpha") and has(i, "beta")),
        ("alpha OR delta", lambda i: has(i, "alpha") or has(i, "delta")),
        ("alpha AND NOT beta", lambda i: has(i, "alpha") and not has(i, "beta")),
        ("NOT (beta OR gamma)", lambda i: not has(i, "beta") and not has(i, "gamma")),
        ("(alpha AND gamma", lambda i: has(i, "alpha") and has(i, "gamma")),
        ("beta)", lambda i: has(i, "beta")),
        ("gamma delta", lambda i: has(i, "gamma") or has(i, "delta")),
        ("NOT (NOT alpha)", lambda i: has(i, "alpha")),
        ("", lambda i: False),
    ],
)
def test_boolean_sets(docs, query, test):
    found = bm25.boolean_search(docs, query, k=None).collect()
    assert {r._id for r in found} == {i for i in (0, 1, 2, 6, 7) if test(i)}
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True) and all(math.isfinite(r.score) for r in found)


def test_scores(docs):
    found = bm25.bm25_search(docs, "beta beta Alpha").collect()
    lengths = [3, 2, 4, 3000, 3]
    avg = sum(lengths) / 5
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    expected = {0: part(2, 3, 3) + part(1, 3, 3), 7: part(2, 3, 3) + part(1, 3, 3), 1: part(1, 2, 3), 2: part(1, 4, 3)}
    assert {r._id: pytest.approx(r.score) for r in found} == expected
    assert [r._id for r in found][:2] == [0, 7]
    assert bm25.bm25_search(docs, "").collect() == [] and bm25.bm25_search(docs.limit(0), "alpha").collect() == []
    with pytest.raises(bm25.TextQueryError):
        bm25.check_text_query("a " * 5000)


def test_stems_and_folds():
    known = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "hoping": "hope", "falling": "fall", "happy": "happi", "relational": "relat", "conditional": "condit", "generously": "generous", "skies": "sky", "national": "nation", "adjustment": "adjust", "running": "run", "knightly": "knight", "consistency": "consist"}
    assert {w: T.stem(w) for w in known} == known
    assert T.fold_words("Ёж ёж ＡＢＣ 日本語") == ["еж", "abc", "日本", "本語"] and T.fold_words(None) == []


def test_vectors(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(900, None), (901, [1.0]), (902, [0.0] * 8)], "_id long, embedding array<float>").cache()
    data = np.vstack([data, np.zeros((1, 8), np.float32)])
    ids = [*range(300), 902]
    q = [float(x) for x in rng.normal(size=8)]
    for m in vectors.METRICS:
        d = vectors.distances(data, np.array([q]), m)[0]
        expected = [ids[i] for i in np.lexsort((ids, d))[:7]]
        assert [r._id for r in vectors.knn(df, q, 7, metric=m).collect()] == expected, m
    queries = df.filter("_id < 20")
    batch = vectors.batch_knn(df.filter("_id <> 901"), queries, 3, block=7).collect()
    assert len(batch) == 60 and {r._id for r in batch if r["rank"] == 1} == set(range(20))
    assert vectors.knn(df, q, 0).collect() == []
    for bad in ([1.0], [float("nan")] * 8):
        with pytest.raises(ValueError):
            vectors.knn(df, bad, 3, dim=8)
    assert vectors.bf16(np.array([1.0, 1.00390625, 3.14159], np.float32)).tolist() == [1.0, 1.0, 3.140625]
    index = vectors.CellIndex.build(df.filter("_id < 300"), cells=16)
    hits = 0
    for i in range(0, 300, 50):
        own = [float(x) for x in data[i]]
        exact = {r._id for r in vectors.knn(df, own, 10).collect()}
        hits += len(exact & {r._id for r in index.search(own, 10, probes=12).collect()})
    assert hits / 60 >= 0.9


def test_fusion(spark, docs):
    lists = [spark.createDataFrame([(1, 0), (2, 1)], "_id long, rank int"), spark.createDataFrame([(2, 0), (3, 1)], "_id long, rank int")]
    assert {r._id: r.score for r in hybrid.rrf(lists, k=-1).collect()} == {1: 1 / 60, 2: 1 / 61 + 1 / 60, 3: 1 / 61}
    assert [r._id for r in hybrid.search(docs, text="beta", filter=Field("_id", Lt(7)), limit=1).collect()] == [0]
    assert hybrid.search(docs).collect() == [] and [r._id for r in hybrid.search(docs, filter=Field("_id", Ge(6))).collect()] == [6, 7]


def test_cells_find_what_a_scan_finds(spark, sf):
    """The registered query with its own setting, on its own table; then all metrics on clustered vectors."""
    from engram.retrieval import knn_cells

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    data, ids = np.stack(rows.embedding.to_numpy()), rows.vec_id.to_numpy()
    exact = {int(q): {int(ids[i]) for i in np.lexsort((ids, d))[:10]} for q, d in zip(ids[ids % 50 == 0], vectors.distances(data, data[ids % 50 == 0], "euclidean"))}
    found: dict[int, set[int]] = {}
    for r in knn_cells(spark, sf).collect():
        found.setdefault(r.query, set()).add(r.vec_id)
    assert found.keys() == exact.keys()
    assert sum(len(found[q] & exact[q]) for q in exact) / (10 * len(exact)) >= 0.9

    rng = np.random.default_rng(2)
    data = (rng.normal(size=(20, 6))[rng.integers(0, 20, 400)] * 4 + rng.normal(size=(400, 6))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(900, [0.0] * 6)], "_id long, embedding array<float>").cache()
    for m in vectors.METRICS:
        index = vectors.CellIndex.build(df, cells=12, metric=m)
        for r, s in zip(vectors.knn(df, data[3], 9, metric=m).collect(), index.search(data[3], 9, probes=1).collect(), strict=True):
            assert r._id == s._id and abs(r.distance - s.distance) < 1e-5, m


def test_all_vectors_and_documents_are_paired(spark):
    from engram.retrieval import paired

    some = spark.createDataFrame([(i, "t") for i in range(1, 1501)], "doc_id long, text string")
    ids = [7 * i - 900 for i in range(700)]
    rows = spark.createDataFrame([(i, [float(i)]) for i in ids], "vec_id long, embedding array<float>")
    found = {r.doc_id: int(r.embedding[0]) for r in paired(some, rows).collect()}
    assert found == {i: ids[i % 700] for i in range(1, 1501)}
    assert {r.embedding for r in paired(some, rows.limit(0)).collect()} == {None}


def test_long_documents_are_folded_whole(spark):
    long = " ".join(f"w{i}" for i in range(400)) + " " * (1 << 20) + "end"
    df = spark.createDataFrame([(long,)], "text string")
    assert df.select(T.folded("text").alias("w")).first().w == [*(f"w{i}" for i in range(400)), "end"]
    assert T.fold_words("a b a c", most=2) == ["a", "b"] and T.fold_words("ab cd", chars=2) == ["ab"]


def test_text_queries_as_trees():
    t, any_, all_, no = bm25.Term, lambda *p: bm25.Any_(p), lambda *p: bm25.All_(p), bm25.Not_
    a, b, c, d = map(t, "abcd")
    cases = {
        "A": a, "a AND b": all_(a, b), "a OR b": any_(a, b), "NOT a": no(a), "a b c": any_(a, b, c), "NOT a b": no(any_(a, b)),
        "(a AND b) OR (c AND NOT d)": any_(all_(a, b), all_(c, no(d))), "(a AND b": all_(a, b), "a AND b)": all_(a, b), "(a AND (b OR c)": all_(a, any_(b, c)),
        "a AND b))": all_(a, b), "a) OR b)": any_(a, b), "NOT NOT a))": no(no(a)), ")))": any_(), "": any_(), "a AND b OR c": any_(all_(a, b), c), "a OR b AND NOT (c OR d)": any_(a, all_(b, no(any_(c, d)))),
        "a AND": any_(a, t("and")), "OR a": any_(t("or"), a), "a and b": any_(a, t("and"), b), "巨蟹 AND a": all_(t("巨蟹"), a), "a (b AND c)": any_(a, all_(b, c)),
    }
    assert {q: bm25.parse_text(q) for q in cases} == cases
    for flood in ("x" + ")" * 100_000, "(" * 100_000 + "x", ")(" * 50_000, "x" + " )" * 50_000):
        bm25.parse_text(flood)
    assert bm25.parse_text("x" + ")" * 8_190) == t("x") and bm25.check_text_query("x" + ")" * 64) == t("x")
    for bad in ("(" * 65 + "a)", "x" + ")" * 65, "NOT " * 70 + "a", " OR ".join("a" for _ in range(600))):
        with pytest.raises(bm25.TextQueryError):
            bm25.check_text_query(bad)
    wide = {"a AND NOT b": False, "a OR NOT b": True, "a AND NOT (b AND NOT c)": False, "a AND NOT (b OR NOT c)": True, "a AND NOT (NOT b)": True, "NOT a AND NOT b": True}
    assert {q: bm25.needs_complement(bm25.parse_text(q)) for q in wide} == wide


def test_text_index(spark, tmp_path):
    rng = np.random.default_rng(8)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"], rng.integers(0, 9))) for i in range(60)}
    make = lambda keys: spark.createDataFrame([(k, None if k is None else texts.get(k, "alpha"), "c") for k in keys], "_id long, text string, word string")
    index = bm25.TextIndex(spark, f"file://{tmp_path}/i", buckets=8)
    assert index.search("alpha").collect() == [] and index.stats().first().n == 0
    index.add(make([*range(0, 40), 3, None]))
    index.remove(make([5, 6, 7, 999]))
    index.add(make([*range(40, 60), 6]))
    left = [k for k in range(60) if k not in (5, 7)]

    def same():
        plain = lambda df: [(r._id, round(r.score, 9)) for r in df.collect()]
        for q in ("beta rho beta", "none"):
            assert plain(index.search(q, k=30)) == plain(bm25.bm25_search(make(left), q, k=30))
        for q in ("alpha AND NOT beta", "NOT alpha", "gamma OR (rho AND delta)", ""):
            assert plain(index.boolean(q, k=None)) == plain(bm25.boolean_search(make(left), q, k=None))

    same()
    index.compact()
    assert len(index.segments()) == 1
    same()
    with pytest.raises(bm25.TextQueryError):
        index.boolean("NOT alpha", most_complement=10)


def test_several_indexes(spark):
    rows = [(1, "red fox", "quick", [1.0, 0.0], [0.0, 0.0, 1.0]), (2, "blue fox", "slow", [0.0, 1.0], [0.0, 1.0, 0.0]), (3, "none", "quick fox", None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "_id long, text string, more string, v2 array<double>, v3 array<double>")
    score = lambda *ranks: sum(1 / (60 + r) for r in ranks)
    found = {r._id: r.score for r in hybrid.search(df, text="quick fox", text_column=("text", "more")).collect()}
    # of each text a list of its own: 1 and 2 stand in the first, 3 and 1 in the second
    assert found == {1: pytest.approx(score(0, 1)), 2: pytest.approx(score(1)), 3: pytest.approx(score(0))}
    columns = {"v2": 2, "v3": 3}
    assert [r._id for r in hybrid.search(df, vector=[0.0, 1.0], vector_column=columns, limit=1).collect()] == [2]
    assert {r._id for r in hybrid.search(df, text="red", vector=[1.0] * 5, vector_column=columns).collect()} == {1}
    with pytest.raises(ValueError):
        hybrid.search(df, vector=[1.0] * 5, vector_column=columns)
