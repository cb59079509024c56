"""Text analysis: tokens, scripts, folding and English stems."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MAX_TOKEN_BYTES = 32


def tokens(text: str | Column, max_bytes: int | None = None) -> Column:
    """Lower-case runs of letters and digits of more than one byte; null text has none.

    ``max_bytes`` also drops tokens of that many bytes or more.
    """
    c = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    keep = lambda t: (F.octet_length(t) > 1) if max_bytes is None else (F.octet_length(t) > 1) & (F.octet_length(t) < max_bytes)
    return F.coalesce(F.filter(parts, keep), F.array().cast("array<string>"))


def equals(word: str):
    return lambda x: x == F.lit(word)


def count_words(text: str | Column, words: list[str]) -> Column:
    """How often each of the words stands in a text: a map word -> count of those that occur."""
    t = tokens(text)
    counts = [F.struct(F.lit(w).alias("key"), F.size(F.filter(t, equals(w))).alias("value")) for w in dict.fromkeys(words)]
    return F.map_from_entries(F.filter(F.array(*counts), lambda x: x["value"] > 0))


#: scripts by character class
SCRIPTS = {
    "Cjk": r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]",
    "Latin": r"[A-Za-zÀ-ɏ]",
    "Cyrillic": r"[Ѐ-ӿ]",
    "Arabic": r"[؀-ۿݐ-ݿ]",
}


def detect_script(text: str | Column) -> Column:
    """Cjk if any such character occurs, else the most frequent of Latin, Cyrillic, Arabic (Latin wins ties), else Other."""
    c = F.col(text) if isinstance(text, str) else text
    n = {k: F.length(c) - F.length(F.regexp_replace(c, v, "")) for k, v in SCRIPTS.items()}
    most = F.greatest(n["Latin"], n["Cyrillic"], n["Arabic"])
    return F.when(n["Cjk"] > 0, "Cjk").when(F.coalesce(most, F.lit(0)) == 0, "Other").when(n["Latin"] == most, "Latin").when(n["Cyrillic"] == most, "Cyrillic").otherwise("Arabic")


def fold_words(text: str | None, most: int | None = None, chars: int | None = None) -> list[str]:
    """Distinct words in order after NFKC, lower case and folds of some letters; runs of CJK become overlapping pairs (no dictionary is at hand).

    For search strings ``most`` words of the first ``chars`` characters can be asked for (256 and 1 Mi in the reference); documents are folded whole.
    """
    if not text:
        return []
    plain = unicodedata.normalize("NFKC", text[:chars]).lower().translate(str.maketrans("ёأإآىة", "еااايه"))
    plain = "".join(c for c in plain if not (0x064B <= ord(c) <= 0x0652 or c in "\u0640\u0670"))
    out: dict[str, None] = {}
    for run in re.findall(r"[぀-ヿ㐀-鿿가-힯]+|[^\W_぀-ヿ㐀-鿿가-힯]+", plain):
        cjk = "぀" <= run[0] <= "힯" and len(run) > 1
        for w in [run[i : i + 2] for i in range(len(run) - 1)] if cjk else [run]:
            out.setdefault(w)
            if len(out) == most:
                return list(out)
    return list(out)


@F.pandas_udf(ArrayType(StringType()))
def folded(text: pd.Series) -> pd.Series:
    return text.map(fold_words)


_V = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.search(r"[aeiouy][^aeiouy]", w[start:])
        return start + m.end() if m else len(w)

    special = re.match(r"gener|commun|arsen", w)
    r1 = special.end() if special else after(0)
    return r1, after(r1)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(re.search(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", w))


# Fixed values of the published English stemming algorithm: whole-word exceptions and suffix tables.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEEP = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_LATE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = "ization=ize ational=ate fulness=ful ousness=ous iveness=ive tional=tion biliti=ble lessli=less entli=ent ation=ate alism=al aliti=al ousli=ous iviti=ive fulli=ful enci=ence anci=ance abli=able izer=ize ator=ate alli=al bli=ble"
_STEP3 = "ational=ate tional=tion alize=al icate=ic iciti=ic ical=ic ful= ness="
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic"


def stem(word: str) -> str:
    """English stem of a lower-case word (the published algorithm's second version)."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    if w in _KEEP:
        return w
    w = re.sub(r"(^|[aeiouy])y", lambda m: m.group(1) + "Y", w)
    r1, r2 = _regions(w.lower() if "Y" not in w else w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _LATE:
        return w
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m:
        cut = m.start()
        if m.group(1) in ("eed", "eedly"):
            if cut >= r1:
                w = w[:cut] + "ee"
        elif re.search(r"[aeiouy]", w[:cut]):
            w = w[:cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _short(w, r1):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for a, b in (x.split("=") for x in _STEP2.split()):
        if w.endswith(a):
            if len(w) - len(a) >= r1:
                w = w[: -len(a)] + b
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in "cdeghkmnrt":
            w = w[:-2]
    for a, b in (x.split("=") for x in _STEP3.split()):
        if w.endswith(a):
            if len(w) - len(a) >= r1:
                w = w[: -len(a)] + b
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for a in _STEP4.split():
        if w.endswith(a):
            if len(w) - len(a) >= r2:
                w = w[: -len(a)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in "st":
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not re.search(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    cache: dict[str, str] = {}
    one = lambda w: cache.get(w) or cache.setdefault(w, stem(w))
    return words.map(lambda ws: [] if ws is None else [one(w) for w in ws])
