"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are the word n-grams of the items that are rare in the corpus; where a passage
of an item has too few of these, as when the item leaked very often, its rarest ones
are taken whatever their frequency. Documents are read once: their words become the
numbers these have in the items, those that hold any n-gram of an item are kept in
that form, and the n-grams' document counts are summed. Where seeds of an item stand
on near diagonals, as many as survive the allowed errors in its least passage, the
words around them are aligned with the item's. Only the items, read in blocks of a
stated number of bytes, are sent to the executors; documents never move.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.lookalikes import LOOKALIKES, invisible
from engram.runtime import materialize

_LATIN = {a: b for source, target in LOOKALIKES.values() for a, b in zip(source, target)}
_LOOK = re.compile("[" + "".join(_LATIN) + "]")
_WORD = re.compile(r"[^\W_]+")
_WORD_OR_END = re.compile(r"[^\W_]+|\x00")


@functools.lru_cache(maxsize=1)
def _dropped() -> re.Pattern:
    """Combining and invisible characters."""
    codes = [c for c in range(0x300, 0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or invisible(chr(c)))]
    runs: list[list[int]] = []
    for c in [0xAD, *codes]:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]+")


def _plain(text: str) -> str:
    if not text.isascii():
        latin = lambda t: _LOOK.sub(lambda m: _LATIN[m.group()], t)
        text = unicodedata.normalize("NFKD", latin(text))
        if not text.isascii():
            text = latin(_dropped().sub("", text))
    return text.casefold()


def words(text: str | None) -> list[str]:
    """Words without regard to case, accents, punctuation, blanks, look-alike and invisible characters."""
    return _WORD.findall(_plain(text)) if text else []


@dataclass(frozen=True)
class LeakParameters:
    """n: words of a seed (an item of fewer words has one seed, itself). rare: share of all documents up to which
    an n-gram counts as rare. enough: seeds that every passage of the least length has at least. passage: least
    share of an item's words. identity: least share of the passage's words that are the item's. block: bytes of
    items' text that are sent to the executors at once."""

    n: int = 3
    enough: int = 12
    rare: float = 0.002
    passage: float = 0.4
    identity: float = 0.8
    block: int = 32 << 20


def align_many(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Best local alignments (match 1, other word, added or left-out word -1): first and last item word, equal words.

    All pairs go through the table row by row at once; a cell carries where its
    alignment began and how many words of it are equal, so no table is kept.
    """
    count, n, m = len(items), max(map(len, items), default=0), max(map(len, texts), default=0)
    a, t = np.full((count, n), -3, dtype=np.int32), np.full((count, m), -4, dtype=np.int32)
    for k, (x, y) in enumerate(zip(items, texts)):
        a[k, : len(x)], t[k, : len(y)] = x, y
    score, begun, equal = (np.zeros((count, m + 1), dtype=np.int32) for _ in range(3))
    place, best, out = np.arange(m + 1, dtype=np.int32), np.zeros(count, dtype=np.int32), np.zeros((count, 3), dtype=np.int64)
    for i in range(1, n + 1):
        hit = t == a[:, i - 1, None]
        diagonal = score[:, :-1] + np.where(hit, 1, -1).astype(np.int32)
        base, first, same = score - 1, begun.copy(), equal.copy()
        use = diagonal >= base[:, 1:]
        np.copyto(base[:, 1:], diagonal, where=use)
        np.copyto(first[:, 1:], begun[:, :-1], where=use)
        np.copyto(same[:, 1:], equal[:, :-1] + hit, where=use)
        none = base <= 0
        base[none], first[none], same[none] = 0, i, 0
        # words of the text that the item lacks: the best cell to the left, less the distance
        base += place
        run = np.maximum.accumulate(base, axis=1)
        origin = np.maximum.accumulate(np.where(base == run, place, 0), axis=1)
        score, begun, equal = run - place, np.take_along_axis(first, origin, 1), np.take_along_axis(same, origin, 1)
        top = score.argmax(axis=1)
        reached = score[np.arange(count), top]
        better = np.flatnonzero(reached > best)
        if len(better):
            best[better] = reached[better]
            out[better] = np.stack([begun[better, top[better]], np.full(len(better), i), equal[better, top[better]]], axis=1)
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment of one pair."""
    first, last, equal = align_many([item], [text])[0].tolist()
    return first, last, equal


def _mixed(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n codes from each place on; places with less than n codes have none."""
    out = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
    for k in range(n):
        x = codes[k : len(codes) - n + 1 + k].astype(np.uint64) + np.uint64(1 + 0x632BE5AB * k)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out = out * np.uint64(0x9E3779B97F4A7C15) + (x ^ (x >> np.uint64(31)))
    return out


class _Items:
    """A block of items: words as numbers, n-grams as hashes."""

    def __init__(self, texts: Iterable[tuple], p: LeakParameters):
        self.code: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.ids: list = []
        for item, text in texts:
            w = words(text)
            if w:
                self.ids.append(item)
                self.words.append(np.array([self.code.setdefault(x, len(self.code)) for x in w], dtype=np.int32))
        self.n = [min(p.n, len(w)) for w in self.words]
        self.hashes = [_mixed(w, n) for w, n in zip(self.words, self.n)]
        self.lengths = sorted(set(self.n))
        self.grams = np.unique(np.concatenate(self.hashes)) if self.hashes else np.zeros(0, dtype=np.uint64)


def _numbered(texts: Iterable[str | None], code: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts as numbers (-1 for words no item has), and each word's text."""
    plain = "\x00".join("" if not t else _plain(t.replace("\x00", " ")) for t in texts)
    get = code.get
    found = np.fromiter((-2 if t == "\x00" else get(t, -1) for t in _WORD_OR_END.findall(plain)), dtype=np.int32)
    end = found == -2
    return found[~end], np.cumsum(end)[~end]


def _found(codes: np.ndarray, of: np.ndarray, known: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, index of the known hash) of the n-grams within one text that are known."""
    for n in lengths:
        if len(codes) < n or not len(known):
            continue
        inside = of[n - 1 :] == of[: len(of) - n + 1]
        for k in range(n):
            inside &= codes[k : len(codes) - n + 1 + k] >= 0
        places = np.flatnonzero(inside)
        h = _mixed(codes, n)[places]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        yes = known[at] == h
        yield places[yes], at[yes]


def _kept(docs: DataFrame, doc_id: str, text: str, items: _Items) -> DataFrame:
    """Rows of two kinds: documents that hold an n-gram (doc, codes), and an n-gram's number of documents (gram, df; gram -1 for all)."""
    known = docs.sparkSession.sparkContext.broadcast((items.code, items.grams, items.lengths))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, grams, lengths = known.value
        total, number = np.zeros(len(grams), dtype=np.int64), 0
        for pdf in batches:
            if not len(pdf):
                continue
            number += len(pdf)
            codes, of = _numbered(pdf[text], code)
            pairs = [of[places] * len(grams) + at for places, at in _found(codes, of, grams, lengths)]
            pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
            total += np.bincount(pairs % max(1, len(grams)), minlength=len(grams))
            hold = np.unique(pairs // max(1, len(grams)))
            low, high = np.searchsorted(of, hold), np.searchsorted(of, hold, "right")
            if len(hold):
                yield pd.DataFrame({"doc": pdf[doc_id].to_numpy()[hold], "codes": [codes[a:b] for a, b in zip(low, high)], "gram": None, "df": None})
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"doc": None, "codes": None, "gram": [-1, *seen.tolist()], "df": [number, *total[seen].tolist()]})

    return docs.select(doc_id, text).filter(F.col(doc_id).isNotNull()).mapInPandas(run, f"doc {kind}, codes array<int>, gram long, df long")


class _Seeds:
    """The seeds of a block of items, sorted by hash."""

    def __init__(self, items: _Items, df: np.ndarray, documents: int, p: LeakParameters):
        self.words, self.ids, self.n, self.lengths = items.words, items.ids, items.n, items.lengths
        self.least, self.at = [], []
        for w, n, h in zip(items.words, items.n, items.hashes):
            often = df[np.searchsorted(items.grams, h)]
            take = set(np.flatnonzero(often <= p.rare * documents).tolist())
            # every passage of the least length gets enough seeds, its rarest n-grams, however frequent these are
            inside = max(1, math.ceil(p.passage * len(w)) - n + 1)
            for at in range(max(1, len(h) - inside + 1)):
                span = range(at, min(at + inside, len(h)))
                lacks = p.enough - sum(k in take for k in span)
                if lacks > 0:
                    take.update(sorted((k for k in span if k not in take), key=lambda k: (often[k], k))[:lacks])
            # seeds within the poorest passage of the least length; an n-gram survives errors with identity ** n, half of that is asked for
            has = np.cumsum([0] + [k in take for k in range(len(h))])
            poorest = int((has[inside:] - has[:-inside]).min()) if len(has) > inside else len(take)
            self.least.append(max(1, math.ceil(poorest * p.identity**n / 2)))
            self.at.append(np.array(sorted(take), dtype=np.int64))
        every = np.concatenate([h[a] for h, a in zip(items.hashes, self.at)]) if self.at else np.zeros(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.item = np.concatenate([np.full(len(a), i) for i, a in enumerate(self.at)])[order] if self.at else np.zeros(0, dtype=np.int64)
        self.place = np.concatenate(self.at)[order] if self.at else np.zeros(0, dtype=np.int64)
        self.hash, self.first = np.unique(every[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(every)))

    def hits(self, codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, place in the item, place in all codes) of all seeds that occur, in this order."""
        parts = [(p, a) for p, a in _found(codes, of, self.hash, self.lengths)]
        places = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
        at = np.concatenate([a for _, a in parts]) if parts else np.zeros(0, dtype=np.int64)
        many = self.many[at]
        where = np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        item, inside, j = self.item[where], self.place[where], np.repeat(places, many)
        order = np.lexsort((j - inside, item, of[j]))
        return of[j][order], item[order], inside[order], j[order]


def _bands(at: np.ndarray, j: np.ndarray, size: int, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches of a text, of at most twice the item's words, in which an alignment can lie: with the seeds' places.

    Hits come in order of their diagonal (j - at). Errors move a passage's diagonal by
    at most a quarter of the item, so a band of that width holds all its seeds; bands
    begin half a width apart and are half a width wider, so each lies whole in one.
    """
    diagonal = j - at
    slack = size // 4 + 2
    start = 0
    while start < len(at):
        stop = int(np.searchsorted(diagonal, diagonal[start] + slack + slack // 2, "right"))
        held = np.unique(at[start:stop])
        if len(held) >= least:
            yield int(diagonal[start]) - slack // 2, int(diagonal[stop - 1]) + size + slack // 2, held
        start = int(np.searchsorted(diagonal, diagonal[start] + slack // 2, "right"))


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", parameters: LeakParameters = LeakParameters()) -> DataFrame:
    """Documents that hold a passage of an item: doc_id, item_id, covered (share of the item's words the passage spans), identity.

    Null and empty texts hold nothing and are held by nothing; repeated rows count
    once; of several passages of an item in a document the longest counts. Further
    columns are ignored, and both tables may use the same names.
    """
    p, spark = parameters, docs.sparkSession
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, covered double, identity double"
    items = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).dropna()
    parts = max(1, math.ceil((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / p.block))
    found = None
    for part in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == part)
        block = _Items(((r.i, r.t) for r in own.toLocalIterator()), p)
        kept = materialize(_kept(docs, doc_id, text, block), "leak_words")
        df, documents = np.zeros(len(block.grams), dtype=np.int64), 0
        for r in kept.filter("gram is not null").groupBy("gram").agg(F.sum("df").alias("df")).toLocalIterator():
            if r.gram < 0:
                documents = r.df
            else:
                df[r.gram] = r.df
        known = spark.sparkContext.broadcast(_Seeds(block, df, documents, p))

        def run(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            s = known.value
            for pdf in batches:
                if not len(pdf):
                    continue
                length = np.array([len(c) for c in pdf["codes"]])
                begin, codes = np.cumsum(length) - length, np.concatenate(pdf["codes"].to_numpy())
                doc, item, at, j = s.hits(codes, np.repeat(np.arange(len(pdf)), length))
                cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))) if len(doc) else []
                tries = []
                for a, b in zip(cut, np.append(cut[1:], len(doc))):
                    d, i = doc[a], item[a]
                    if b - a >= s.least[i]:
                        tries += [(d, i, max(0, low), high, held) for low, high, held in _bands(at[a:b], j[a:b] - begin[d], len(s.words[i]), s.least[i])]
                tries.sort(key=lambda x: (len(s.words[x[1]]), x[3] - x[2]))
                best: dict = {}
                while tries:
                    # so many at once that a row of the table has about a hundred thousand cells
                    some, tries = tries[: (n := max(1, 100_000 // (tries[0][3] - tries[0][2] + 1)))], tries[n:]
                    found = align_many([s.words[i] for _, i, *_ in some], [codes[begin[d] + low : begin[d] + min(high, length[d])] for d, _, low, high, _ in some])
                    for (d, i, _, _, held), (first, last, equal) in zip(some, found.tolist()):
                        span, size = last - first, len(s.words[i])
                        if span < p.passage * size or equal < p.identity * span or not span:
                            continue
                        # sentences of one pattern agree in their common words only: rare ones must agree as well
                        inside = lambda x, first=first, last=last, n=s.n[i]: ((x >= first) & (x <= last - n)).sum()
                        if inside(held) >= inside(s.at[i]) * p.identity ** s.n[i] / 2:
                            best[d, i] = max(best.get((d, i), (0.0, 0.0)), (span / size, equal / span))
                if best:
                    yield pd.DataFrame([(pdf["doc"].iat[d], s.ids[i], *x) for (d, i), x in best.items()], columns=["doc_id", "item_id", "covered", "identity"])

        result = kept.filter("doc is not null").select("doc", "codes").mapInPandas(run, schema)
        found = result if found is None else found.unionByName(result)
    return found.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("identity").alias("identity"))
