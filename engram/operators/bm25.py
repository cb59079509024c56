"""BM25 full-text search and boolean text queries.

``bm25_search`` and ``boolean_search`` work on any table of documents: one pass counts
the query's words where the documents are, all else reads these counts. ``TextIndex``
keeps the exploded postings of a corpus in folders by word hash, in segments that are
added, marked as removed and compacted; a search of it reads its words' folders only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import isfinite, log
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import tokens
from engram.runtime import materialize

MAX_QUERY_BYTES, MAX_QUERY_DEPTH, MAX_QUERY_NODES, MAX_QUERY_BRANCHES = 8192, 64, 1024, 512


@dataclass(frozen=True)
class Bm25:
    """k1 in [0, 1000], b in [0, 1]; values that aren't finite become the defaults."""

    k1: float = 1.2
    b: float = 0.75

    def fixed(self) -> tuple[float, float]:
        k1 = min(max(self.k1, 0.0), 1000.0) if isfinite(self.k1) else 1.2
        return k1, min(max(self.b, 0.0), 1.0) if isfinite(self.b) else 0.75


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Any_:
    parts: tuple


@dataclass(frozen=True)
class All_:
    parts: tuple


@dataclass(frozen=True)
class Not_:
    part: Any


class TextQueryError(ValueError):
    pass


@dataclass
class _Group:
    """What stands between two brackets so far: finished alternatives, finished parts of the last one, the operand being read."""

    alternatives: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    operand: list = field(default_factory=list)
    negations: int = 0

    def end_operand(self) -> None:
        node = self.operand[0] if len(self.operand) == 1 else Any_(tuple(self.operand))
        for _ in range(self.negations):
            node = Not_(node)
        self.parts.append(node)
        self.operand, self.negations = [], 0

    def end_alternative(self) -> None:
        self.end_operand()
        self.alternatives.append(self.parts[0] if len(self.parts) == 1 else All_(tuple(self.parts)))
        self.parts = []

    def node(self) -> Any:
        self.end_alternative()
        return self.alternatives[0] if len(self.alternatives) == 1 else Any_(tuple(self.alternatives))


def parse_text(query: str) -> Any:
    """A tree of Term, Any_, All_ and Not_.

    OR binds least, then AND, NOT and words side by side, which are alternatives. The
    operators are in capitals between blanks and have an operand on either side (NOT
    after it); elsewhere they are words. A bracket that nothing closes ends with the
    query, one that closes nothing is left out. Read from left to right with a stack,
    so no nesting is too deep for it.
    """
    found = list(re.finditer(r"[()]|[^\s()]+", query))
    stack = [_Group()]
    for i, m in enumerate(found):
        text, group = m.group(), stack[-1]
        more = i + 1 < len(found) and found[i + 1].group() != ")"
        spaced = more and query[m.end()].isspace() and (m.start() == 0 or query[m.start() - 1].isspace() or query[m.start() - 1] == "(")
        if text == "(":
            stack.append(_Group())
        elif text == ")":
            if len(stack) > 1:
                stack.pop()
                stack[-1].operand.append(group.node())
        elif text == "NOT" and spaced and not group.operand:
            group.negations += 1
        elif text == "AND" and spaced and group.operand:
            group.end_operand()
        elif text == "OR" and spaced and group.operand:
            group.end_alternative()
        else:
            group.operand.append(Term(text.lower()))
    while len(stack) > 1:
        inner = stack.pop().node()
        stack[-1].operand.append(inner)
    return stack[0].node()


def needs_complement(tree: Any) -> bool:
    """Whether all documents but some must be gathered: a NOT that no other part of its AND narrows down."""
    match tree:
        case Not_():
            return True
        case Any_(parts):
            return any(map(needs_complement, parts))
        case All_(parts):
            wanted = [p for p in parts if not isinstance(p, Not_)]
            return not wanted or any(map(needs_complement, wanted)) or any(needs_complement(p.part) for p in parts if isinstance(p, Not_))
    return False


def check_text_query(query: str) -> Any:
    """Parse, refusing queries that are too long, deep or wide."""
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise TextQueryError("the query is too long")
    open_ = deepest = stray = 0
    for c in query:
        if c == "(":
            open_ += 1
        elif c == ")":
            open_, stray = (open_ - 1, stray) if open_ else (0, stray + 1)
        deepest = max(deepest, open_, stray)
    if deepest > MAX_QUERY_DEPTH:
        raise TextQueryError("the query has too many brackets")
    tree = parse_text(query)
    level, nodes, depth = [tree], 0, 0
    while level:
        nodes, depth = nodes + len(level), depth + 1
        kids = [list(n.parts) if isinstance(n, (Any_, All_)) else [n.part] if isinstance(n, Not_) else [] for n in level]
        if nodes > MAX_QUERY_NODES or depth > MAX_QUERY_DEPTH or any(len(k) > MAX_QUERY_BRANCHES for k in kids):
            raise TextQueryError("the query is too complex")
        level = [x for k in kids for x in k]
    return tree


Analyzer = Callable[[Column], Column]


def _analyzed(docs: DataFrame, key: str, text: str | list[str], analyzer: Analyzer) -> DataFrame:
    """(key, words) of documents with at least one word; several fields are joined by line breaks."""
    c = F.concat_ws("\n", *text) if isinstance(text, list) else F.col(text)
    return docs.select(F.col(key).alias("_key"), analyzer(c).alias("words")).filter(F.size("words") > 0)


def _words_of(spark, analyzer: Analyzer, texts: list[str]) -> list[list[str]]:
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", analyzer(F.col("t")).alias("w")).collect()
    return [r.w for r in sorted(rows, key=lambda r: r.i)]


def corpus_stats(docs: DataFrame, key: str, text: str | list[str], analyzer: Analyzer = tokens) -> DataFrame:
    """n documents with words, all words, average length (at least 1)."""
    return _analyzed(docs, key, text, analyzer).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).select("n", "words", F.greatest(F.coalesce(F.try_divide("words", "n"), F.lit(1.0)), F.lit(1.0)).alias("avgdl"))


def postings(docs: DataFrame, key: str, text: str | list[str], analyzer: Analyzer = tokens) -> DataFrame:
    """(word, key, tf, dl): the exploded index, for bulk scoring."""
    rows = _analyzed(docs, key, text, analyzer).select("_key", F.size("words").alias("dl"), F.explode("words").alias("word"))
    return rows.groupBy("word", F.col("_key").alias(key)).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def _score(tf: Column, dl: Column, n: int, df: int, avg: float, params: Bm25) -> Column:
    k1, b = params.fixed()
    f = tf.cast("double")
    return F.lit(log(1 + (n - df + 0.5) / (df + 0.5))) * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avg))


@dataclass(frozen=True)
class _Counted:
    """Documents (_key, dl, one count a query word) and the corpus: n documents, their average length, documents a word."""

    rows: DataFrame
    n: int
    avg: float
    df: dict[str, int]
    params: Bm25

    def words(self) -> dict[str, tuple[Column, Column]]:
        """word -> (it occurs, its score)."""
        out = {}
        for i, (w, df) in enumerate(self.df.items()):
            has = F.coalesce(F.col(f"tf{i}"), F.lit(0)) > 0
            out[w] = (has, F.when(has, _score(F.col(f"tf{i}"), F.col("dl"), self.n, df, self.avg, self.params)).otherwise(0.0))
        return out


def _counted(docs: DataFrame, key: str, text: str | list[str], words: list[str], params: Bm25, analyzer: Analyzer) -> _Counted:
    """The counts of the query's words, from one pass over the texts."""
    rows = _analyzed(docs, key, text, analyzer)
    tf = lambda w: F.size("words") - F.size(F.array_remove("words", F.lit(w)))
    counted = materialize(rows.select("_key", F.size("words").alias("dl"), *[tf(w).alias(f"tf{i}") for i, w in enumerate(words)]), "counted")
    sums = counted.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), *[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)) for i in range(len(words))]).first()
    return _Counted(counted, sums[0], max(sums[1] / sums[0] if sums[0] else 1.0, 1.0), dict(zip(words, sums[2:])), params)


def _best(hits: DataFrame, score: Column, key: str, k: int | None) -> DataFrame:
    out = hits.select(F.col("_key").alias(key), score.alias("score")).orderBy(F.desc("score"), key)
    return out if k is None else out.limit(k)


def _any_word(c: _Counted, key: str, k: int | None) -> DataFrame:
    hit, score = F.lit(False), F.lit(0.0)
    for has, s in c.words().values():
        hit, score = hit | has, score + s
    return _best(c.rows.filter(hit), score, key, k)


def bm25_search(docs: DataFrame, query: str, *, key: str = "_id", text: str | list[str] = "text", k: int = 10, params: Bm25 = Bm25(), analyzer: Analyzer = tokens) -> DataFrame:
    """(key, score) of the best k documents that hold any word of the query.

    Repeated words of the query count once. Best score first, then least key. No
    query word, no document with words: empty. Null texts hold no words.
    """
    words = list(dict.fromkeys(_words_of(docs.sparkSession, analyzer, [query])[0]))
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    return _any_word(_counted(docs, key, text, words, params, analyzer), key, k)


def _terms(tree: Any) -> list[str]:
    match tree:
        case Term(t):
            return [t]
        case Any_(parts) | All_(parts):
            return [t for p in parts for t in _terms(p)]
        case Not_(x):
            return _terms(x)
    raise TextQueryError(repr(tree))


def _solved(tree: Any, read: dict[str, list[str]], by_word: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """(a document satisfies the tree, its score)."""
    match tree:
        case Term(t):
            hit, score = F.lit(False), F.lit(0.0)
            for w in dict.fromkeys(read[t]):
                hit, score = hit | by_word[w][0], score + by_word[w][1]
            return hit, score
        case Any_(parts):
            hit, score = F.lit(False), F.lit(0.0)
            for h, s in (_solved(p, read, by_word) for p in parts):
                hit, score = hit | h, score + F.when(h, s).otherwise(0.0)
            return hit, score
        case All_(parts):
            hit, score = F.lit(True), F.lit(0.0)
            for p in parts:
                h, s = _solved(p, read, by_word)
                hit, score = hit & h, score + (F.lit(0.0) if isinstance(p, Not_) else s)
            return hit, score
        case Not_(x):
            return ~_solved(x, read, by_word)[0], F.lit(0.0)
    raise TextQueryError(repr(tree))


def _read_query(spark: SparkSession, query: str, analyzer: Analyzer) -> tuple[Any, dict[str, list[str]], list[str]]:
    """The tree, the words of each of its terms, and all words."""
    tree = check_text_query(query)
    terms = _terms(tree)
    read = dict(zip(terms, _words_of(spark, analyzer, terms))) if terms else {}
    return tree, read, list(dict.fromkeys(w for ws in read.values() for w in ws))


def boolean_search(docs: DataFrame, query: str, *, key: str = "_id", text: str | list[str] = "text", k: int | None = 10, params: Bm25 = Bm25(), analyzer: Analyzer = tokens, most_complement: int | None = None) -> DataFrame:
    """(key, score) of documents that satisfy a boolean query.

    OR adds its branches' scores, AND too but asks for all; NOT scores 0. A term of
    several words is any of them. ``most_complement`` refuses a NOT that nothing
    narrows down over more documents.
    """
    tree, read, words = _read_query(docs.sparkSession, query, analyzer)
    c = _counted(docs, key, text, words, params, analyzer)
    if most_complement is not None and needs_complement(tree) and c.n > most_complement:
        raise TextQueryError(f"NOT over more than {most_complement} documents")
    hit, score = _solved(tree, read, c.words())
    return _best(c.rows.filter(hit), score, key, k)


class TextIndex:
    """Postings of a corpus below a folder all executors share.

    Each ``add`` writes a segment: postings (word, key, tf, dl) in folders by word hash,
    and the documents' lengths. ``remove`` notes keys with the segment they end; later
    segments may hold them again. ``compact`` writes what is left as one segment.
    """

    def __init__(self, spark: SparkSession, path: str, *, key_type: str = "long", analyzer: Analyzer = tokens, buckets: int = 64):
        self.spark, self.path, self.key_type, self.analyzer, self.buckets = spark, path.rstrip("/"), key_type, analyzer, buckets

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self, kind: str) -> list[int]:
        fs, p = self._fs(kind)
        done = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x.getName()) for x in done if fs.exists(self._fs(f"{kind}/{x.getName()}/_SUCCESS")[1]))

    def segments(self) -> list[int]:
        """Segments whose last part, the documents, is there."""
        return self._numbers("documents")

    def _next(self) -> int:
        return max([0, *self.segments(), *self._numbers("removed")]) + 1

    def _write(self, rows: DataFrame, number: int) -> None:
        rows = materialize(rows, "analyzed")
        bucket = F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int").alias("bucket")
        words = rows.select("_key", F.size("words").alias("dl"), F.explode("words").alias("word")).groupBy("word", "_key").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))
        # hot words are spread by their documents within the bucket's folder
        words.select("*", bucket).repartition("bucket", F.pmod(F.xxhash64("_key"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/{number}")
        rows.select("_key", F.size("words").alias("dl")).write.mode("overwrite").parquet(f"{self.path}/documents/{number}")

    def add(self, docs: DataFrame, key: str = "_id", text: str | list[str] = "text") -> int:
        """Index documents with words; ones with a null key or none are left out. Returns the segment."""
        number = self._next()
        rows = _analyzed(docs.filter(F.col(key).isNotNull()), key, text, self.analyzer)
        self._write(rows.withColumn("_key", F.col("_key").cast(self.key_type)).dropDuplicates(["_key"]), number)
        return number

    def remove(self, keys: DataFrame, key: str = "_id") -> int:
        """Take documents out of all segments so far; unknown keys are nothing."""
        number = self._next()
        keys.select(F.col(key).cast(self.key_type).alias("_key")).dropna().distinct().write.mode("overwrite").parquet(f"{self.path}/removed/{number}")
        return number

    def _removed(self) -> DataFrame | None:
        """(_key, until): the last segment that a removal ends."""
        parts = [self.spark.read.parquet(f"{self.path}/removed/{r}").withColumn("until", F.lit(r)) for r in self._numbers("removed")]
        return reduce(DataFrame.unionByName, parts).groupBy("_key").agg(F.max("until").alias("until")) if parts else None

    def _live(self, kind: str, words: Sequence[str] | None = None) -> DataFrame:
        schema = f"_key {self.key_type}, dl int" if kind == "documents" else f"word string, _key {self.key_type}, tf int, dl int, bucket int"
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{n}").withColumn("segment", F.lit(n)) for n in self.segments()]
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema + ", segment int")
        if words is not None:
            own = self.spark.createDataFrame([(w,) for w in words], "word string").select(F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()
            rows = rows.filter(F.col("bucket").isin([r.b for r in own]) & F.col("word").isin(list(words)))
        gone = self._removed()
        if gone is None:
            return rows
        return rows.join(gone, "_key", "left").filter("until is null or segment > until").drop("until")

    def documents(self) -> DataFrame:
        """(_key, dl) of all documents; of a key in several segments the last counts."""
        return self._live("documents").groupBy("_key").agg(F.max_by("dl", "segment").alias("dl"), F.max("segment").alias("segment"))

    def stats(self) -> DataFrame:
        """n documents, all words, average length (at least 1)."""
        return self.documents().agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).select("n", "words", F.greatest(F.coalesce(F.try_divide("words", "n"), F.lit(1.0)), F.lit(1.0)).alias("avgdl"))

    def compact(self) -> int:
        """One segment of all that counts; the others and the removals are dropped after it is there."""
        old, removed, number = self.segments(), self._numbers("removed"), self._next()
        docs = materialize(self.documents(), "live")
        last = docs.select("_key", "segment")
        self._live("postings").join(last, ["_key", "segment"], "left_semi").drop("segment").repartition("bucket", F.pmod(F.xxhash64("_key"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/{number}")
        docs.select("_key", "dl").write.mode("overwrite").parquet(f"{self.path}/documents/{number}")
        for kind, n in [*(("documents", n) for n in old), *(("removed", n) for n in removed), *(("postings", n) for n in old)]:
            fs, p = self._fs(f"{kind}/{n}")
            fs.delete(p, True)
        return number

    def _counted(self, words: list[str], params: Bm25, every: bool) -> _Counted:
        n, _, avg = self.stats().first()
        several = len(self.segments()) > 1
        rows = self._live("postings", words)
        if several:
            rows = rows.join(self.documents().select("_key", "segment"), ["_key", "segment"], "left_semi")
        at = [F.max(F.when(F.col("word") == w, F.col("tf"))).alias(f"tf{i}") for i, w in enumerate(words)]
        df = {r.word: r.n for r in rows.groupBy("word").agg(F.count("*").alias("n")).collect()}  # one row a query word
        found = rows.groupBy("_key").agg(F.max("dl").alias("dl"), *at)
        if every:
            found = self.documents().select("_key", "dl").join(found.drop("dl"), "_key", "left")
        return _Counted(found, n, avg, {w: df.get(w, 0) for w in words}, params)

    def search(self, query: str, *, key: str = "_id", k: int = 10, params: Bm25 = Bm25()) -> DataFrame:
        """As ``bm25_search``."""
        words = list(dict.fromkeys(_words_of(self.spark, self.analyzer, [query])[0]))
        if not words:
            return self.spark.createDataFrame([], f"{key} {self.key_type}, score double")
        return _any_word(self._counted(words, params, False), key, k)

    def boolean(self, query: str, *, key: str = "_id", k: int | None = 10, params: Bm25 = Bm25(), most_complement: int | None = None) -> DataFrame:
        """As ``boolean_search``; all documents are read only if a NOT asks for them."""
        tree, read, words = _read_query(self.spark, query, self.analyzer)
        every = needs_complement(tree)
        c = self._counted(words, params, every) if words or every else None
        if c is None:
            return self.spark.createDataFrame([], f"{key} {self.key_type}, score double")
        if most_complement is not None and every and c.n > most_complement:
            raise TextQueryError(f"NOT over more than {most_complement} documents")
        hit, score = _solved(tree, read, c.words())
        return _best(c.rows.filter(hit), score, key, k)
