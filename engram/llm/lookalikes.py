"""One consistent form for text that looks the same but is stored in different characters.

Strings that look alike are joined to classes by union-find: full-width and
joined forms with what they stand for, composed with combined letters, blanks of
all kinds, letters of other scripts with the Latin ones they look like, and all
invisible characters with nothing. Of each class the member most frequent in the
corpus becomes the representative; texts are then rewritten, single characters
through a table and longer patterns greedily by an Aho-Corasick automaton.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.pairs import blocked_join

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXGQWaesijopcyxhdqwl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγιονρυϲϳ", "ABEZHIKMNOPTYXayiovpucj"),
    "Armenian": ("ՍՕսօոհ", "UOuonh"),
    "Latin": ("ɑɡɩ", "agi"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦ", "DRTAJEWMHGZVSLCPK"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Coptic": ("ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "HIKMNOoPpCcTYX"),
}
# Compatibility forms that differ to the eye (raised, lowered, circled, fractions, squares) keep their own form.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>"}


def invisible(c: str) -> bool:
    """Characters without a glyph: format characters, fillers and variation selectors."""
    o = ord(c)
    return unicodedata.category(c) == "Cf" or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


def _twins(c: str) -> Iterator[str]:
    """Strings that a character looks the same as."""
    if unicodedata.category(c) == "Zs":
        yield " "
    mapping = unicodedata.decomposition(c)
    if mapping:
        if not mapping.startswith("<"):
            yield unicodedata.normalize("NFD", c)
            yield unicodedata.normalize("NFC", c)
        elif mapping.split()[0] in _SAME_LOOK or (mapping.startswith("<compat>") and unicodedata.category(c)[0] == "L" and len(mapping.split()) > 2) or c in "ſ":
            yield unicodedata.normalize("NFKC", c)


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


class Rewriter:
    """The consistent form of texts, for a corpus with the given counts of characters and strings."""

    def __init__(self, counts: dict[str, int]):
        chars = {c for s in counts for c in s}
        chars |= {unicodedata.normalize("NFC", s) for s in counts if len(s) > 1 and len(unicodedata.normalize("NFC", s)) == 1}
        pairs = [(a, b) for source, target in LOOKALIKES.values() for a, b in zip(source, target)]
        chars |= {c for pair in pairs for c in pair} | {" "}
        # the characters that the twins of characters consist of
        for _ in range(3):
            chars |= {x for c in chars for t in _twins(c) for x in t}
        self.drop = {c for c in chars if invisible(c)}
        single, strings = Classes(), Classes()
        for a, b in pairs:
            single.join(a, b)
        long: list[tuple[str, str]] = []
        for c in sorted(chars - self.drop):
            for t in _twins(c):
                (single.join(c, t) if len(t) == 1 else long.append((c, t)))
        best = lambda xs, n: min(xs, key=lambda x: (-n.get(x, 0), len(x), x))
        self.table = {ord(c): "" for c in self.drop}
        for group in single.members().values():
            top = best(group, counts)
            self.table |= {ord(x): top for x in group if x != top}
        # longer strings, spelled in the representatives of their characters
        one = lambda s: s.translate(self.table)
        number: Counter = Counter()
        for s, n in counts.items():
            number[one(s)] += n
        for c, t in long:
            if len(one(c)) != 1:
                continue
            strings.join(one(c), one(t))
            if len(t) > 2:  # partly composed
                strings.join(one(c), one(unicodedata.normalize("NFC", t[:-1]) + t[-1]))
        self.patterns: dict[str, str] = {}
        for group in strings.members().values():
            top = best(group, number)
            self.patterns |= {x: top for x in group if x != top}
        self.plain_ascii = not any(p.isascii() for p in self.patterns) and all(k > 127 or chr(k) == v for k, v in self.table.items())
        self._machine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def __call__(self, text: str) -> str:
        if self.plain_ascii and text.isascii():
            return text
        text = text.translate(self.table)
        if self.plain_ascii and text.isascii() or not self.patterns:
            return text
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for p in self.patterns:
                self._machine.add_word(p, p)
            self._machine.make_automaton()
        out, at = [], 0
        for end, p in self._machine.iter_long(text):
            out += (text[at : end + 1 - len(p)], self.patterns[p])
            at = end + 1
        return "".join(out) + text[at:] if at else text


_JOINED = [c for c in map(chr, range(0xFB00, 0xFB07))]


def count_strings(texts: Iterable[str]) -> Counter:
    """How often each character occurs, and each string that has a one-character form."""
    whole = "\n".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found, n = np.unique(codes, return_counts=True)
    counts = Counter({chr(c): int(k) for c, k in zip(found, n) if not 0xD800 <= c < 0xE000})
    marks = np.isin(codes, [c for c in found if unicodedata.combining(chr(c))])
    at = np.flatnonzero(marks)
    at = at[at > 0]
    if len(at):
        for pair, k in Counter(zip(codes[at - 1].tolist(), codes[at].tolist())).items():
            s = chr(pair[0]) + chr(pair[1])
            if len(unicodedata.normalize("NFC", s)) == 1:
                counts[s] += k
    for s in {unicodedata.normalize("NFKC", c) for c in _JOINED}:
        if n := whole.count(s):
            counts[s] += n
    return counts


def corpus_counts(texts: DataFrame, column: str = "text") -> dict[str, int]:
    """Counts over all texts, reduced on the executors; there are at most as many strings as Unicode has characters and compositions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            total.update(count_strings(t for t in pdf[column] if t))
        if total:
            yield pd.DataFrame({"s": list(total), "n": list(total.values())})

    sums = texts.select(column).mapInPandas(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return {r.s: r.n for r in sums.toLocalIterator()}


@functools.lru_cache(maxsize=4)
def _loaded(state: bytes) -> Rewriter:
    import pickle

    return pickle.loads(state)


def rewriter_for(texts: DataFrame, column: str = "text") -> Rewriter:
    return Rewriter(corpus_counts(texts, column))


def consistent(column: Column, rewriter: Rewriter) -> Column:
    """The consistent form of a text column; null stays null."""
    import pickle

    state = pickle.dumps(rewriter)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        r = _loaded(state)
        return s.map(lambda t: None if t is None else r(t))

    return run(column)


def fingerprints(docs: DataFrame, key: str, text: str, rewriter: Rewriter) -> DataFrame:
    """(key, stored, form): 128-bit hashes of each text as stored and in the consistent form; null texts are left out."""
    import pickle

    state = pickle.dumps(rewriter)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = _loaded(state)
        digest = lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
        for pdf in batches:
            pdf = pdf[pdf[text].notna()]
            if not len(pdf):
                continue
            stored = pdf[text].map(digest)
            form = [s if r.plain_ascii and t.isascii() else digest(r(t)) for t, s in zip(pdf[text], stored)]
            yield pd.DataFrame({key: pdf[key], "stored": stored, "form": form})

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, stored binary, form binary")


def lookalike_pairs(prints: DataFrame, key: str) -> DataFrame:
    """(a, b) for keys a < b of equal form that are stored differently.

    Pairs are made of the different stored texts of a form first and then expanded
    to their documents, so a text with very many exact copies is never compared
    with itself: the work is in proportion to the result, and that of a form with
    very many documents is split among tasks.
    """
    variants = prints.groupBy("form", "stored").agg(F.count("*").alias("n"))
    several = variants.groupBy("form").agg(F.count("*").alias("k")).filter("k > 1").select("form")
    variants = variants.join(several, "form", "left_semi").select("form", "stored")
    meet = variants.join(variants.withColumnRenamed("stored", "other"), "form").filter(F.col("stored") != F.col("other"))
    docs = prints.join(several, "form", "left_semi").select("form", "stored", F.col(key).alias("k")).distinct()
    left = docs.withColumnRenamed("k", "a").join(meet, ["form", "stored"]).select("form", "other", "a")
    right = docs.select("form", F.col("stored").alias("other"), F.col("k").alias("b"))
    return blocked_join(left, right, ["form", "other"]).filter("a < b").select("a", "b").distinct()
