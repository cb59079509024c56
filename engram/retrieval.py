"""Registered queries of document retrieval: filters, paging, text, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import bm25, hybrid, paging, vectors
from engram.operators.filters import AllOf, And, AnyOf, Between, Eq, Field, Ge, Gt, Include, Le, Lt, NoneOf, Not, Or, Prefix, where
from engram.operators.running import running_sum
from engram.runtime import scratch_path, table

_QUERY = "policy thermostat greenhouse assertion"
_BOOL = {
    "bool_or": "policy OR (thermostat AND evidence)",
    "bool_and": "evidence AND (supports OR names) AND policy",
    "bool_not": "policy AND NOT evidence AND NOT (concept OR remember)",
    "bool_nested": "(policy OR transaction) AND NOT (NOT evidence)",
}


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey"), F.split("p_type", " ").alias("tags"), "p_size")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "map<string,int>").alias("props"), "value")


def _pick(key: str, make, node):
    return lambda spark, d: where(make(spark, d), node).select(key)


_FILTERS = {
    "rq_eq": ("o_orderkey", _orders, Field("o_orderstatus", Eq("F")), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "rq_gt": ("o_orderkey", _orders, Field("o_totalprice", Gt(200000.0)), "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000"),
    "rq_ge": ("o_orderkey", _orders, Field("o_custkey", Ge(700)), "SELECT o_orderkey FROM orders WHERE o_custkey >= 700"),
    "rq_lt": ("o_orderkey", _orders, Field("o_custkey", Lt(70)), "SELECT o_orderkey FROM orders WHERE o_custkey < 70"),
    "rq_le": ("o_orderkey", _orders, Field("o_custkey", Le(70)), "SELECT o_orderkey FROM orders WHERE o_custkey <= 70"),
    "rq_between": ("o_orderkey", _orders, Field("o_custkey", Between(100, 200)), "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 100 AND 200"),
    "rq_between_inverted": ("o_orderkey", _orders, Field("o_custkey", Between(200, 100)), "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 200 AND 100"),
    "rq_include": ("o_orderkey", _orders, Field("o_custkey", Include((1, 5, 77, 410, 5))), "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 5, 77, 410)"),
    "rq_and": ("o_orderkey", _orders, Field("o_custkey", AllOf((Gt(10), Lt(60), NoneOf(Eq(33))))), "SELECT o_orderkey FROM orders WHERE o_custkey > 10 AND o_custkey < 60 AND o_custkey <> 33"),
    "rq_and_empty": ("o_orderkey", _orders, Field("o_custkey", AllOf(())), "SELECT o_orderkey FROM orders WHERE false"),
    "rq_or": ("o_orderkey", _orders, Field("o_custkey", AnyOf((Lt(20), Gt(1400), Eq(500)))), "SELECT o_orderkey FROM orders WHERE o_custkey < 20 OR o_custkey > 1400 OR o_custkey = 500"),
    "rq_not": ("o_orderkey", _orders, Field("o_orderstatus", NoneOf(Eq("F"))), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "rq_array": ("p_partkey", _tagged, Field("tags", Prefix("S")), "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_type, ' '), lambda x: starts_with(x, 'S'))) > 0"),
    "rq_array_not": ("p_partkey", _tagged, Field("tags", NoneOf(Eq("SMALL"))), "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_type, ' '), lambda x: x <> 'SMALL')) > 0"),
    "rq_map": ("event_id", _mapped, Field("props", Eq("k")), "SELECT event_id FROM events WHERE list_contains(json_keys(props), 'k')"),
    "rq_id": ("o_orderkey", _orders, Field("o_orderkey", AnyOf((Le(40), Between(1000, 1040)))), "SELECT o_orderkey FROM orders WHERE o_orderkey <= 40 OR o_orderkey BETWEEN 1000 AND 1040"),
    "composite_eq": ("o_orderkey", _orders, Field(("o_orderstatus", "o_orderpriority"), Eq(("F", "1-URGENT"))), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "flt_field": ("_id", lambda s, d: table(s, d, "assertions"), Field("evidence_refs", Prefix("E-1")), "SELECT _id FROM assertions WHERE len(list_filter(evidence_refs, lambda x: starts_with(x, 'E-1'))) > 0"),
    "flt_and": ("o_orderkey", _orders, And((Field("o_orderstatus", Eq("O")), Field("o_totalprice", Lt(50000.0)))), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 50000"),
    "flt_or": ("o_orderkey", _orders, Or((Field("o_orderpriority", Prefix("1")), Field("o_totalprice", Gt(300000.0)))), "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' OR o_totalprice > 300000"),
    "flt_not": ("_id", lambda s, d: table(s, d, "propositions"), Not(Field("object_key", Prefix("id"))), "SELECT _id FROM propositions WHERE NOT coalesce(object_key LIKE 'id%', false)"),
    "flt_not_null": ("_id", lambda s, d: table(s, d, "assertions"), And((Not(Field("stance", Eq("support"))), Not(Field("mode", NoneOf(Eq("stated")))))), "SELECT _id FROM assertions WHERE NOT coalesce(stance = 'support', false) AND NOT coalesce(mode <> 'stated', false)"),
    "flt_null_range_not": ("_id", lambda s, d: table(s, d, "assertions"), Field("stance", NoneOf(Eq("support"))), "SELECT _id FROM assertions WHERE stance <> 'support'"),
    "prefix": ("c_custkey", lambda s, d: table(s, d, "customer"), Field("c_mktsegment", Prefix("A")), "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'A%'"),
}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars", "source")


def _query_vector(spark: SparkSession, d: str, vec_id: int = 7) -> list[float]:
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding)


def _distance(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "embeddings")
        q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
        return rows.select("vec_id", (F.round(vectors.distance(F.col("embedding").cast("array<double>"), q, metric), 5) + 0.0).alias("distance"))

    return run


def _knn(metric: str):
    return lambda spark, d: vectors.knn(table(spark, d, "embeddings"), _query_vector(spark, d), 10, key="vec_id", metric=metric, dim=64).select("vec_id", (F.round("distance", 5) + 0.0).alias("distance"))


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    found = vectors.batch_knn(rows, rows.filter("vec_id % 50 = 0"), 5, key="vec_id")
    return found.select("query", "vec_id", (F.round("distance", 5) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


def knn_cells(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every id divisible by 50, among all vectors."""
    rows = table(spark, d, "embeddings")
    found = vectors.CellIndex.build(rows, key="vec_id").search_batch(rows.filter("vec_id % 50 = 0"), 10)
    return found.select("query", "vec_id", (F.round("distance", 5) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


def quantize_bf16(spark: SparkSession, d: str) -> DataFrame:
    """A checksum of each vector after rounding: the sum of its values times their places."""
    q = table(spark, d, "embeddings").select("vec_id", vectors.quantize_bf16("embedding").alias("q"))
    weighted = F.transform("q", lambda x, i: x.cast("double") * (i + 1))
    return q.select("vec_id", F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 6).alias("checksum"))


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    s = bm25.corpus_stats(_docs(spark, d), "doc_id", "text")
    return s.select("n", "words", F.round("avgdl", 6).alias("avgdl"))


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return bm25.bm25_search(_docs(spark, d), _QUERY, key="doc_id", k=20).select("doc_id", F.round("score", 6).alias("score"))


def bm25_fields(spark: SparkSession, d: str) -> DataFrame:
    return bm25.bm25_search(_docs(spark, d), "wiki chat policy", key="doc_id", text=["source", "text"], k=20).select("doc_id", F.round("score", 6).alias("score"))


def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return bm25.postings(_docs(spark, d), "doc_id", "text").groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return bm25.bm25_search(_docs(spark, d), "policies supporting instructions", key="doc_id", k=20, analyzer=lambda c: T.stems(T.tokens(c, T.MAX_TOKEN_BYTES))).select("doc_id", F.round("score", 6).alias("score"))


def _boolean(query: str):
    return lambda spark, d: bm25.boolean_search(_docs(spark, d), query, key="doc_id", k=None).select("doc_id", F.round("score", 6).alias("score"))


def tok_collect(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(T.tokens("text")).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def tok_default(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(T.stems(T.tokens("text", T.MAX_TOKEN_BYTES))).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


def tok_fold(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(T.folded("text"), " ").alias("words"))


def flat_ft_search(spark: SparkSession, d: str) -> DataFrame:
    hits = T.count_words("text", ["policy", "evidence", "der"])
    return _docs(spark, d).select("doc_id", F.explode(hits).alias("word", "n")).withColumn("n", F.col("n").cast("long"))


def detect_script(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.detect_script("text").alias("script"))


def rrf(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    a = hybrid.ranked(docs.orderBy(F.desc("n_chars"), "doc_id").limit(100), [F.desc("n_chars"), "doc_id"], "doc_id")
    b = hybrid.ranked(docs.orderBy("doc_id").limit(150), ["doc_id"], "doc_id")
    return hybrid.rrf([a, b], key="doc_id").select("doc_id", F.round("score", 9).alias("score"))


def paired(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents with a vector each: the tables share no key, so the n vectors are dealt out in order of their ids, by the document's number modulo n.

    All vectors are dealt if the documents' numbers reach all remainders; no document is left out.
    """
    rows = rows.select("vec_id", "embedding").filter("embedding is not null")
    n, low, high = rows.agg(F.count("*"), F.min("vec_id"), F.max("vec_id")).first()
    if not n:
        return docs.withColumn("embedding", F.lit(None).cast("array<float>"))
    bucket = F.floor((F.col("vec_id") - low) / max(1, (high - low + 1) // -(-n // 100_000)))
    places = running_sum(rows.select("vec_id", F.lit(1).alias("one")), "one", [], bucket, [F.col("vec_id")], "place")
    dealt = rows.join(places.select("vec_id", (F.col("place") - 1).alias("place")), "vec_id").drop("vec_id")
    return docs.withColumn("place", F.pmod("doc_id", F.lit(n))).join(dealt, "place", "left").drop("place")


def _with_vectors(spark: SparkSession, d: str) -> DataFrame:
    return paired(_docs(spark, d), table(spark, d, "embeddings"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    node = And((Field("lang", Eq("en")), Field("n_chars", Between(200, 2000))))
    found = hybrid.search(_with_vectors(spark, d), text=_QUERY, vector=_query_vector(spark, d), filter=node, limit=20, key="doc_id")
    return found.select("doc_id", F.round("score", 9).alias("score"))


def search_filtered_text(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: full-text search over all documents, ten times as many ranked as asked for, then filtered; best 20."""
    docs, limit = _docs(spark, d), 20
    node = And((Field("lang", Eq("en")), Field("n_chars", Between(200, 2000))))
    found = bm25.bm25_search(docs, _QUERY, key="doc_id", k=paging.candidates(limit))
    kept = found.join(where(docs, node).select("doc_id"), "doc_id", "left_semi")
    return kept.orderBy(F.desc("score"), "doc_id").limit(limit).select("doc_id", F.round("score", 6).alias("score"))


def _index(spark: SparkSession, d: str) -> bm25.TextIndex:
    """An index of two segments, the documents of even and of odd number."""
    index = bm25.TextIndex(spark, scratch_path(spark, "text_index"))
    for rest in (0, 1):
        index.add(_docs(spark, d).filter(F.col("doc_id") % 2 == rest), "doc_id")
    return index


def index_search(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(_QUERY, key="doc_id", k=20).select("doc_id", F.round("score", 6).alias("score"))


def index_boolean(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).boolean(_BOOL["bool_not"], key="doc_id", k=None).select("doc_id", F.round("score", 6).alias("score"))


def index_remove(spark: SparkSession, d: str) -> DataFrame:
    """Search after all documents of one source were removed and the index was compacted."""
    index = _index(spark, d)
    index.remove(_docs(spark, d).filter(F.lower(F.trim("source")) == "chat"), "doc_id")
    index.compact()
    return index.search(_QUERY, key="doc_id", k=20).select("doc_id", F.round("score", 6).alias("score"))


def query_ids(spark: SparkSession, d: str) -> DataFrame:
    return paging.query_ids(_orders(spark, d), Field("o_orderstatus", Eq("F")), 50, key="o_orderkey")


def query_last_ids(spark: SparkSession, d: str) -> DataFrame:
    return paging.query_last_ids(_orders(spark, d), Field("o_orderstatus", Eq("F")), 50, key="o_orderkey")


def query_all_ids(spark: SparkSession, d: str) -> DataFrame:
    return paging.query_all_ids(_orders(spark, d), Field("o_custkey", Lt(100)), key="o_orderkey")


def cursor_page(spark: SparkSession, d: str) -> DataFrame:
    return paging.query_last_ids(_orders(spark, d), And((Field("o_custkey", Le(300)), Field("o_orderkey", Lt(9000)))), 25, key="o_orderkey")


def keys_page(spark: SparkSession, d: str) -> DataFrame:
    return paging.keys_page(_tagged(spark, d), "tags", "B", 12)


def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return paging.page(_orders(spark, d).select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 30, 20)


def get_many(spark: SparkSession, d: str) -> DataFrame:
    found = paging.get_many(table(spark, d, "customer").select("c_custkey", "c_name"), [5, 3, 99999999, 5, 1], key="c_custkey")
    return found.select(F.col("pos").cast("long").alias("pos"), "c_custkey", "c_name")


def scan_collection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concepts").groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("_id").alias("ids"))


def search_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    found = bm25.bm25_search(docs, _QUERY, key="doc_id", k=10)
    # ten ranked ids meet their documents and keep their order
    return docs.join(found, "doc_id").orderBy(F.desc("score"), "doc_id").select("doc_id", F.round("score", 6).alias("score"), "lang", "n_chars")


_PLAIN = (knn_batch, knn_cells, quantize_bf16, bm25_stats, bm25_search, bm25_fields, bm25_postings, bm25_stemmed, tok_collect, tok_default, tok_fold, flat_ft_search, detect_script, rrf, hybrid_search, search_filtered_text, index_search, index_boolean, index_remove, query_ids, query_last_ids, query_all_ids, cursor_page, keys_page, offset_page, get_many, scan_collection, search_docs)


def queries() -> dict:
    out = {k: _pick(*v[:3]) for k, v in _FILTERS.items()}
    out |= {f"dist_{m}": _distance(m) for m in vectors.METRICS} | {f"knn_{m}": _knn(m) for m in vectors.METRICS}
    out |= {k: _boolean(q) for k, q in _BOOL.items()}
    return out | {f.__name__: f for f in _PLAIN}


_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: octet_length(encode(x)) > 1)"


def _bm25_sql(words: list[str], text: str = "text", source: str = "documents", k: str = "LIMIT 20") -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""WITH d AS (SELECT doc_id, {_WORDS.format(text)} AS w FROM {source}), k AS (SELECT * FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS n, greatest(sum(len(w)) / count(*), 1) AS avgdl FROM k),
p AS (SELECT doc_id, len(w) AS dl, unnest([{listed}]) AS q, w FROM k),
t AS (SELECT doc_id, dl, q, len(list_filter(w, lambda x: x = q)) AS tf FROM p),
f AS (SELECT q, count(*) FILTER (tf > 0) AS df FROM t GROUP BY q),
r AS (SELECT doc_id, q, CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) ELSE 0 END AS sc, tf > 0 AS hit FROM t JOIN f USING (q), s),
o AS (SELECT doc_id, sum(sc) AS score FROM r GROUP BY doc_id HAVING bool_or(hit) ORDER BY score DESC, doc_id {k})"""


def _bool_sql(words: list[str], condition: str, score: str) -> str:
    flags = ", ".join(f"bool_or(hit) FILTER (q = '{w}') AS {w}, sum(sc) FILTER (q = '{w}') AS s_{w}" for w in words)
    return f"{_bm25_sql(words)}, b AS (SELECT doc_id, {flags} FROM r GROUP BY doc_id) SELECT doc_id, round({score}, 6) AS score FROM b WHERE {condition}"


_DIST = {
    "euclidean": "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "cosine": "1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "inner_product": "-list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "manhattan": "list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda x: abs(x[1] - x[2])))",
}


def oracle_sql() -> dict[str, str]:
    out = {k: v[3] for k, v in _FILTERS.items()}
    pair = "FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q"
    for m, s in _DIST.items():
        out[f"dist_{m}"] = f"SELECT e.vec_id, round({s}, 5) + 0.0 AS distance {pair}"
        out[f"knn_{m}"] = f"SELECT vec_id, round(d, 5) + 0.0 AS distance FROM (SELECT e.vec_id, {s} AS d {pair} ORDER BY d, e.vec_id LIMIT 10)"
    words = _QUERY.split()
    other = "(SELECT * FROM documents WHERE coalesce(lower(trim(source)), '') <> 'chat')"
    dealt = """(SELECT d.*, e.embedding FROM documents d LEFT JOIN (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings) e ON e.place = d.doc_id % e.n)"""
    bf16 = "CASE WHEN x = 0 THEN 0 ELSE round_even(x::DOUBLE / pow(2, floor(log2(abs(x::DOUBLE))) - 7), 0) * pow(2, floor(log2(abs(x::DOUBLE))) - 7) END"
    return out | {
        "knn_batch": f"SELECT query, vec_id, round(d, 5) + 0.0 AS distance, rank FROM (SELECT q.vec_id AS query, e.vec_id, {_DIST['euclidean']} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST['euclidean']}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 5",
        "knn_cells": f"SELECT query, vec_id, round(d, 5) + 0.0 AS distance, rank FROM (SELECT q.vec_id AS query, e.vec_id, {_DIST['euclidean']} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST['euclidean']}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 10",
        "quantize_bf16": f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: ({bf16}) * i)), 6) AS checksum FROM embeddings",
        "bm25_stats": f"{_bm25_sql(words)} SELECT count(*) AS n, sum(len(w)) AS words, round(greatest(sum(len(w)) / count(*), 1), 6) AS avgdl FROM k",
        "bm25_search": f"{_bm25_sql(words)} SELECT doc_id, round(score, 6) AS score FROM o",
        "bm25_fields": f"{_bm25_sql(['wiki', 'chat', 'policy'], 'concat_ws(chr(10), source, text)')} SELECT doc_id, round(score, 6) AS score FROM o",
        "bm25_postings": f"WITH w AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents) SELECT word, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY word",
        "bool_or": _bool_sql(["policy", "thermostat", "evidence"], "policy OR (thermostat AND evidence)", "s_policy + CASE WHEN thermostat AND evidence THEN s_thermostat + s_evidence ELSE 0 END"),
        "bool_and": _bool_sql(["evidence", "supports", "names", "policy"], "evidence AND (supports OR names) AND policy", "s_evidence + s_supports + s_names + s_policy"),
        "bool_not": _bool_sql(["policy", "evidence", "concept", "remember"], "policy AND NOT evidence AND NOT (concept OR remember)", "s_policy"),
        "bool_nested": _bool_sql(["policy", "transaction", "evidence"], "(policy OR transaction) AND evidence", "s_policy + s_transaction"),
        "tok_collect": f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY ALL",
        "flat_ft_search": f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents) WHERE word IN ('policy', 'evidence', 'der') GROUP BY ALL",
        "detect_script": r"""WITH n AS (SELECT doc_id, len(text) - len(regexp_replace(text, '[\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}]', '', 'g')) AS j, len(text) - len(regexp_replace(text, '[A-Za-z\x{C0}-\x{24F}]', '', 'g')) AS l,
 len(text) - len(regexp_replace(text, '[\x{400}-\x{4FF}]', '', 'g')) AS c, len(text) - len(regexp_replace(text, '[\x{600}-\x{6FF}\x{750}-\x{77F}]', '', 'g')) AS a FROM documents)
SELECT doc_id, CASE WHEN j > 0 THEN 'Cjk' WHEN greatest(l, c, a) = 0 THEN 'Other' WHEN l >= c AND l >= a THEN 'Latin' WHEN c >= a THEN 'Cyrillic' ELSE 'Arabic' END AS script FROM n""",
        "rrf": "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents QUALIFY r < 100), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents QUALIFY r < 150) SELECT doc_id, round(sum(1 / (60.0 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id",
        "hybrid_search": f"""{_bm25_sql(words, k="LIMIT 200")},
v AS (SELECT e.doc_id, {_DIST['euclidean']} AS x FROM {dealt} e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.embedding IS NOT NULL ORDER BY x, e.doc_id LIMIT 200),
u AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM o UNION ALL SELECT doc_id, row_number() OVER (ORDER BY x, doc_id) - 1 FROM v),
g AS (SELECT doc_id, sum(1 / (60.0 + r)) AS score FROM u GROUP BY doc_id)
SELECT doc_id, round(score, 9) AS score FROM g JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars BETWEEN 200 AND 2000 ORDER BY score DESC, doc_id LIMIT 20""",
        "search_filtered_text": f"{_bm25_sql(words, k='LIMIT 200')} SELECT doc_id, round(score, 6) AS score FROM o JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars BETWEEN 200 AND 2000 ORDER BY o.score DESC, doc_id LIMIT 20",
        "index_search": f"{_bm25_sql(words)} SELECT doc_id, round(score, 6) AS score FROM o",
        "index_boolean": _bool_sql(["policy", "evidence", "concept", "remember"], "policy AND NOT evidence AND NOT (concept OR remember)", "s_policy"),
        "index_remove": f"{_bm25_sql(words, source=other)} SELECT doc_id, round(score, 6) AS score FROM o",
        "query_ids": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 50",
        "query_last_ids": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 DESC LIMIT 50",
        "query_all_ids": "SELECT o_orderkey FROM orders WHERE o_custkey < 100",
        "cursor_page": "SELECT o_orderkey FROM orders WHERE o_custkey <= 300 AND o_orderkey < 9000 ORDER BY 1 DESC LIMIT 25",
        "keys_page": "SELECT DISTINCT key FROM (SELECT unnest(string_split(p_type, ' ')) AS key FROM part) WHERE key > 'B' ORDER BY 1 LIMIT 12",
        "offset_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30",
        "get_many": "SELECT pos, c_custkey, c_name FROM (VALUES (0, 5), (1, 3), (2, 99999999), (3, 5), (4, 1)) v(pos, k) LEFT JOIN customer ON c_custkey = k",
        "scan_collection": "SELECT state, count(*) AS n, count(DISTINCT _id) AS ids FROM concepts GROUP BY state",
        "search_docs": f"{_bm25_sql(words, k='LIMIT 10')} SELECT doc_id, round(score, 6) AS score, lang, n_chars FROM o JOIN documents USING (doc_id)",
    }
