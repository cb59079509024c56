"""Variant spellings of names: a pigeonhole segment join with verification, and entity resolution on top.

``segment_join`` finds all pairs of strings within k edits: a string is cut into
k+1 segments, so two strings within k edits share at least one segment at a
slightly shifted position. Segments go into an inverted index (a join key of
length, segment number and text); the other side looks up its own substrings at
the admissible shifts; a banded edit distance verifies.

``link_names`` compares whole names without regard to the order of their words.
Every word takes part in the join, in three orders of the words, so that no single
edit, not even one that moves a word, hides a pair. What the corpus tells of a word,
the number of different names it stands in, decides whether two similar words
are one word mistyped (a frequent and a rare one) or two (both frequent). Lists of
public short forms of given names and of business words are further evidence only:
they bring a known abbreviation to its long form and are not needed for a link.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.components import connected_components
from engram.runtime import materialize

# Public short forms of given names, titles, legal forms, business words and their abbreviations.
SHORT_FORMS = """
abby=abigail al=albert alex=alexander sasha=alexander xander=alexander andy=andrew drew=andrew angie=angela annie=anne tony=anthony barb=barbara barbie=barbara
becky=rebecca ben=benjamin benny=benjamin benji=benjamin bernie=bernard beth=elizabeth betty=elizabeth liz=elizabeth lizzie=elizabeth eliza=elizabeth betsy=elizabeth
bill=william billy=william will=william willy=william bob=robert bobby=robert rob=robert robbie=robert bert=albert brad=bradley cathy=katherine kathy=katherine
kate=katherine katie=katherine kat=katherine kitty=katherine charlie=charles chuck=charles chaz=charles chris=christopher cindy=cynthia dan=daniel danny=daniel dave=david
deb=deborah debbie=deborah debby=deborah dick=richard rick=richard ricky=richard rich=richard richie=richard don=donald donny=donald doug=douglas ed=edward eddie=edward
ned=edward ted=theodore teddy=theodore theo=theodore frank=francis fran=frances fred=frederick freddy=frederick freddie=frederick gene=eugene gerry=gerald jerry=gerald
gabe=gabriel greg=gregory hank=henry harry=henry hal=henry ike=isaac jack=john johnny=john jake=jacob jamie=james jim=james jimmy=james jeff=jeffrey jen=jennifer
jenny=jennifer jenn=jennifer joe=joseph joey=joseph jo=joanne jon=jonathan josh=joshua judy=judith ken=kenneth kenny=kenneth kim=kimberly larry=lawrence lawrie=lawrence
laurie=lawrence len=leonard lenny=leonard leo=leonard maggie=margaret meg=margaret peggy=margaret marge=margaret matt=matthew matty=matthew mike=michael mick=michael mickey=michael micky=michael
mandy=amanda nancy=anne nate=nathaniel nick=nicholas nicky=nicholas nico=nicholas pam=pamela pat=patricia patty=patricia trish=patricia tricia=patricia patti=patricia pete=peter
phil=philip ray=raymond ron=ronald ronnie=ronald sally=sarah sam=samuel sammy=samuel sandy=sandra steve=stephen steven=stephen stevie=stephen sue=susan susie=susan
suzy=susan tim=timothy timmy=timothy tom=thomas tommy=thomas tommie=thomas val=valerie vicky=victoria vicki=victoria tori=victoria vic=victor vince=vincent walt=walter wally=walter
wes=wesley zach=zachary
"""
TITLES = "dr mr mrs ms miss prof professor sir dame rev hon herr frau"
LEGAL = "gmbh ag ltd limited inc incorporated corp corporation co company llc plc sa kg group the and"
KINDS = """
associates=assoc assn;brothers=bros;department=dept;engineering=engg eng engr;foundation=fdn found;institute=inst;insurance=ins insur;international=intl int;
laboratories=labs lab laboratory;logistics=log logist;manufacturing=mfg manuf;services=svcs svc serv service;shipping=shpg ship;systems=sys syst system;
technologies=tech techs technology;university=univ uni;partners=ptnrs;holdings=hldgs;industries=ind inds;consulting=cons;solutions=soln solns;college=coll;hospital=hosp;bank=bk;council=cncl;agency=agcy
"""

_SHORT = dict(x.split("=") for x in SHORT_FORMS.split())
_TITLES, _LEGAL = set(TITLES.split()), set(LEGAL.split())
_KINDS = {a: k for part in KINDS.replace("\n", "").split(";") if part for k, _, short in [part.partition("=")] for a in [k, *short.split()]}

#: a word in this many different names is an established one; a misspelling is this many times rarer
ESTABLISHED, RARER = 3, 10


def edits(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours counting as one; most + 1 if there are more. Only a band of the table is filled."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    far = most + 1
    before, last = None, [j if j <= most else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            cost = min(last[j - 1] + (a[i - 1] != b[j - 1]), last[j] + 1, row[j - 1] + 1)
            if before and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, before[j - 2] + 1)
            row[j] = min(cost, far)
        if min(row) >= far:
            return far
        before, last = last, row
    return min(last[-1], far)


def fold(text: str) -> str:
    """Lower case without accents, full-width forms and invisible characters."""
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c for c in plain if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").casefold()


def same_word(a: str, b: str, in_a: int, in_b: int, k: int, person: bool) -> bool:
    """Whether two different words are likely one, mistyped.

    ``in_a``, ``in_b``: in how many different names each stands in the corpus. Two
    established words are two words. Words with digits and the shortest must be
    equal. Short words of persons' names differ by slips only (a swap, a doubled
    letter) unless one of them is far rarer, and names that differ in a last a, e or
    o are those of two persons.
    """
    if a == b:
        return True
    least, most = sorted((len(a), len(b)))
    k = min(k, most // 8 + 1)  # one edit in words of up to seven letters
    if least < 3 or not (a.isalpha() and b.isalpha()) or edits(a, b, k) > k:
        return False
    few, many = sorted((in_a, in_b))
    rare = many >= RARER * max(1, few)
    if few >= ESTABLISHED and not rare:
        return False
    if person and (a[:-1] == b[:-1] and {a[-1], b[-1]} <= set("aeo") or least < most and (a if len(a) == most else b)[:least] in (a, b) and max(a, b, key=len)[least:] in ("a", "e", "o")):
        return False
    if most > 5 or not person and least > 3:
        return True
    longer, shorter = max(a, b, key=len), min(a, b, key=len)
    doubled = any(longer[i] == longer[i - 1] and longer[:i] + longer[i + 1 :] == shorter for i in range(1, len(longer)))
    swapped = least == most and sorted(a) == sorted(b)
    return least > 3 and (doubled or swapped) or rare and a[0] == b[0] and a[-1] == b[-1]


def same_name(a: list[str], b: list[str], in_a: list[int], in_b: list[int], k: int, person: bool) -> bool:
    """Whether two lists of words are one name within k edits: every word has a partner, or words were run together."""
    x, y = dict(zip(a, in_a)), dict(zip(b, in_b))
    left, right = [t for t in a if t not in y], [t for t in b if t not in x]
    if len(left) == len(right):
        if len(left) > 3:
            return False
        for order in permutations(right):
            spent = [edits(t, u, k) for t, u in zip(left, order)]
            if sum(spent) <= k and all(same_word(t, u, x[t], y[u], k, person) for t, u in zip(left, order)):
                return True
        return False
    # words run together or cut: of one side one word is left, long enough to be told
    few, many = sorted((left, right), key=len)
    return len(few) == 1 and len(few[0]) >= 8 and any(edits(few[0], "".join(p), k) <= k for p in permutations(many)) if len(many) <= 3 else False


def _initial(words: list[str]) -> str:
    return "".join(w[0] for w in words)


def parse(kind: str, text: str | None) -> list[list[tuple[str, bool]]]:
    """Parts of a written name in the order they are to be read: lists of (word, written as an acronym).

    Remarks in brackets, titles and legal forms are left out, known short forms and
    abbreviations written out; what follows a comma or ``of`` stands before it.
    """
    plain = re.sub(r"\([^)]*\)|[?!]", " ", "" if text is None else text)
    if kind != "Person":  # letters with dots are one word
        plain = re.sub(r"\b(?:\w\.[ ]?){2,}", lambda m: re.sub(r"[. ]", "", m.group()) + " ", plain)
    shouted = not any(c.islower() for c in plain)
    out = []
    for part in plain.split(","):
        pieces = [part] if kind == "Person" else re.split(r"(?i)\bof\b", part)
        tokens = []
        for piece in reversed(pieces):
            for t in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", piece)):
                word = fold(t)
                if not word or word in (_TITLES if kind == "Person" else _LEGAL):
                    continue
                acronym = t.isupper() and t.isalpha() and 2 <= len(t) <= 4 and not shouted
                tokens.append(((_SHORT if kind == "Person" else _KINDS).get(word, word), acronym))
        if tokens:
            out.append(tokens)
    return out


def read(kind: str, words: list[tuple[str, bool, int, int]]) -> tuple[list[str], str, str, str] | None:
    """(words of a full name, base, initials, middle initial): of a short form only the latter three are set; None if a name tells nothing.

    :param words: in reading order: word, acronym, number of different names it
        stands in, and of those that add a number only.
    """
    letters = [w for w, *_ in words if len(w) == 1 and w.isalpha()] if kind == "Person" else []
    names = [x for x in words if len(x[0]) > 1 or kind != "Person"]
    told = [x for x in names if not x[0].isdigit()]
    if not told:
        return None
    if len(told) == 1 and len(names) > 1 and told[0][3] >= ESTABLISHED:
        return None  # one of many that are told apart by a number only
    if kind != "Person":
        if len(names) == 2 and names[1][1] and not names[0][1]:
            return [], names[0][0], names[1][0], ""
        if len(names) == 1 and any(edits(names[0][0], w, 1) <= 1 for w in _KINDS):
            return None
        return [x[0] for x in names], "", "", ""
    if len(names) > 1:
        return [x[0] for x in names], "", "", (letters or [""])[0]
    word, _, others, _ = names[0]
    if letters:
        return [], word, letters[0], (letters[1:] or [""])[0]
    if others or word in _SHORT.values():
        return None  # a bare given or family name
    # an initial and a family name written together, or a single name
    return ([], word[1:], word[0], "") if len(word) > 4 else ([], word, "", "")


def deletions(c: Column, k: int = 1) -> Column:
    """A string and all strings with up to k characters less."""
    def cut(s: Column) -> Column:
        n = F.length(s)
        less = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)))
        return F.array_distinct(F.concat(F.array(s), less))

    out = cut(c)
    for _ in range(k - 1):
        out = F.array_distinct(F.flatten(F.transform(out, cut)))
    return out


def segment_join(df: DataFrame, text: str, within: list[str], k: int = 1, hot: int = 2_000, *, carry: list[str] = (), queries: DataFrame | None = None) -> DataFrame:
    """All pairs of strings with equal ``within`` columns and at most k edits.

    A swap of neighbouring characters is one edit. Null strings are left out, rows
    that agree in all columns count once. Without ``queries`` each pair of different
    rows comes once, text_a the lesser; with them, a is a row of theirs and b one of
    ``df``, equal strings included. ``carry`` columns come as ``<name>_a`` and ``<name>_b``.

    A segment that more than ``hot`` strings share isn't paired as such: its strings
    must also share the rest of the string with k characters deleted, which any two
    strings within k edits do; so common prefixes don't pair all with all.
    """
    carry, n = list(carry), F.length("s")
    rows = lambda x: x.select(*within, F.col(text).alias("s"), *carry).filter("s is not null").distinct()
    # cuts of a string of length n into k+1 segments. A swap across a border spoils two segments, but only of one
    # set of cuts: of k+1 sets, each a character on, one at least has no swap across a border.
    # Of a cut: its set and segment; of a look-up, moreover, the indexed string's length less the own and the shift.
    cuts = [(e, i, 0, 0) for e in range(k + 1) for i in range(k + 1)]
    shifts = [(e, i, d, x) for e, i, _, _ in cuts for d in range(-k, k + 1) for x in range(max(-i, -d - (k - i)), min(i, -d + (k - i)) + 1)]
    border = lambda i: F.floor(F.col("len") * i / (k + 1)).cast("int")
    i, extra = F.col("x.i"), F.col("x.e")
    start = border(i) + F.when(i > 0, extra).otherwise(0) + F.col("x.x")
    stop = F.when(i < k, border(i + 1) + extra).otherwise(F.col("len")) + F.col("x.x")
    # strings so short that k edits may touch all their segments meet by what is left after k deletions
    brief = 3 * (k + 1) + k

    def spread(s: DataFrame, which: list[tuple]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("eidx", w)]) for w in which]))
        cut = s.select(*within, "s", *carry, each.alias("x")).withColumn("len", n + F.col("x.d")).withColumn("at", start).filter("len > 0 and at >= 0")
        cut = cut.select(*within, "s", *carry, (i * 100 + extra).alias("seg"), "len", "at", F.substring(F.col("s"), F.col("at") + 1, stop - F.col("at")).alias("piece")).filter("length(piece) > 0")
        return cut.unionByName(s.filter(n <= brief).select(*within, "s", *carry, F.lit(-1).alias("seg"), F.lit(0).alias("len"), F.lit(0).alias("at"), F.explode(deletions(F.col("s"), k)).alias("piece")))

    index, probe = spread(rows(df), cuts), spread(rows(df if queries is None else queries), shifts)
    keys = [*within, "seg", "len", "piece"]
    crowded = materialize(index.groupBy(*keys).count().filter(F.col("count") > hot).select(*keys, F.lit(True).alias("crowded")), "crowded")
    none = crowded.isEmpty()

    def keyed(side: DataFrame, mark: str) -> DataFrame:
        if none:
            return side.select(*keys, F.lit("").alias("rest"), F.col("s").alias("text" + mark), *[F.col(c).alias(c + mark) for c in carry])
        both = side.join(crowded, keys, "left")
        # what is left of the string when the segment is taken out
        rest = F.concat(F.substring(F.col("s"), F.lit(1), F.col("at")), F.lit("|"), F.substring(F.col("s"), F.col("at") + F.length("piece") + 1, n))
        return both.select(*keys, F.explode(F.when(F.col("crowded") & (F.col("seg") >= 0), deletions(rest, k)).otherwise(F.array(F.lit("")))).alias("rest"), F.col("s").alias("text" + mark), *[F.col(c).alias(c + mark) for c in carry])

    pairs = keyed(probe, "_a").join(keyed(index, "_b"), [*keys, "rest"])
    if queries is None:
        pairs = pairs.filter(F.struct("text_a", *[c + "_a" for c in carry]) < F.struct("text_b", *[c + "_b" for c in carry]))
    # a swap is two plain edits: this bound drops most candidates before they are gathered
    pairs = pairs.filter(F.levenshtein("text_a", "text_b", 2 * k) >= 0)
    pairs = pairs.select(*within, "text_a", "text_b", *[c + m for m in ("_a", "_b") for c in carry]).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pdf[[edits(x, y, k) <= k for x, y in zip(pdf["text_a"], pdf["text_b"])]] if len(pdf) else pdf
            if len(found):
                yield found

    return pairs.mapInPandas(verify, pairs.schema)


def _words_of(mentions: DataFrame) -> DataFrame:
    """(type, written, part, at, word, acronym) of each distinct mention."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(t, w, p, i, word, acronym) for t, w in zip(pdf["type"], pdf["written"]) for p, part in enumerate(parse(t, w)) for i, (word, acronym) in enumerate(part)]
            if out:
                yield pd.DataFrame(out, columns=["type", "written", "part", "at", "word", "acronym"])

    return mentions.select("type", "written").distinct().mapInPandas(run, "type string, written string, part int, at int, word string, acronym boolean")


def _stats(words: DataFrame) -> DataFrame:
    """(type, word, names, numbers): in how many different names of several words a word stands, and how many of these add a number only."""
    part = words.groupBy("type", "written", "part").agg(F.sort_array(F.collect_set("word")).alias("all"))
    names = part.filter(F.size("all") > 1).select("type", "all").distinct()
    number = F.size(F.filter("all", lambda w: ~w.rlike("^[0-9]+$"))) == 1
    return names.select("type", F.explode("all").alias("word"), number.alias("number")).groupBy("type", "word").agg(F.count("*").alias("names"), F.sum(F.col("number").cast("long")).alias("numbers"))


def _generic(mentions: DataFrame, parts: DataFrame) -> DataFrame:
    """(type, label): names that tell nothing, such as roles.

    They stand alone as a name of records whose other names have no word in common
    with them or among each other, and their words hardly stand in other names.
    """
    own = parts.groupBy("type", "written").agg(F.count("*").alias("n"), F.min("label").alias("label"), F.flatten(F.collect_list("words")).alias("words"), F.max("others").alias("others"))
    main = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).getField("w")
    of = mentions.join(own, ["type", "written"]).select("type", "id", F.struct("label", "n", "others", "words", main.alias("main")).alias("x"))
    names = of.groupBy("type", "id").agg(F.collect_set("x").alias("names")).filter(F.size("names") > 1)
    each = names.select("type", "names", F.explode("names").alias("x")).filter("x.n = 1")
    apart = F.filter("names", lambda y: ~F.arrays_overlap(y["words"], F.col("x.words")))
    seen = each.select("type", F.col("x.label").alias("label"), F.col("x.others").alias("others"), F.explode(F.transform(apart, lambda y: y["main"])).alias("main")).distinct()
    return seen.groupBy("type", "label").agg(F.count("*").alias("mains"), F.max("others").alias("others")).filter(f"mains > 1 and others * {RARER} <= mains").select("type", "label")


def read_mentions(mentions: DataFrame) -> DataFrame:
    """(type, written, words, names, base, initials, middle) of each distinct mention that tells a name; full names have words."""
    words = materialize(_words_of(mentions), "name_words")
    stats = _stats(words)
    known = words.join(stats, ["type", "word"], "left").select("type", "written", "part", F.struct("at", "word", "acronym", F.coalesce("names", F.lit(0)).alias("names"), F.coalesce("numbers", F.lit(0)).alias("numbers")).alias("x"))
    parts = known.groupBy("type", "written", "part").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    others = F.array_max(F.transform("xs", lambda x: x["names"] - x["numbers"])) - (F.size("words") > 1).cast("long")
    parts = parts.select("type", "written", "part", "xs", F.col("xs.word").alias("words"), F.array_join("xs.word", " ").alias("label"))
    parts = materialize(parts.withColumn("others", others), "name_label")
    left = parts.join(_generic(mentions, parts), ["type", "label"], "left_anti")
    whole = left.groupBy("type", "written").agg(F.sort_array(F.collect_list(F.struct("part", "xs"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kind, written, found in zip(pdf["type"], pdf["written"], pdf["parts"]):
                flat = [(x["word"], x["acronym"], x["names"], x["numbers"]) for p in reversed(found) for x in p["xs"]]
                r = read(kind, flat)
                if r:
                    names_of = {w: n for w, _, n, _ in flat}
                    full = list(dict.fromkeys(r[0]))
                    out.append((kind, written, full, [names_of[w] for w in full], *r[1:]))
            if out:
                yield pd.DataFrame(out, columns=["type", "written", "words", "names", "base", "initials", "middle"])

    return whole.mapInPandas(run, "type string, written string, words array<string>, names array<long>, base string, initials string, middle string")


def _close_names(full: DataFrame, k: int) -> DataFrame:
    """(a, b) nodes of full names that are one name within k edits. Forms: words as written, and sorted from the front and from the back."""
    mirrored = F.transform(F.array_sort(F.transform("words", F.reverse)), F.reverse)
    forms = F.array_distinct(F.array(F.array_join("words", ""), F.array_join(F.array_sort("words"), ""), F.array_join(mirrored, "")))
    counts = F.transform(F.array_sort(F.arrays_zip("words", "names")), lambda x: x["names"])
    rows = full.select("type", F.explode(forms).alias("form"), F.struct("node", counts.alias("n")).alias("of")).distinct()
    near = segment_join(rows, "form", ["type"], k, carry=["of"]).filter("of_a.node <> of_b.node")
    near = near.select("type", "of_a", "of_b").dropDuplicates(["of_a", "of_b"])

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kind, x, y in zip(pdf["type"], pdf["of_a"], pdf["of_b"]):
                a, b = (v["node"].split("|", 1)[1].split(" ") for v in (x, y))
                if same_name(a, b, list(x["n"]), list(y["n"]), k, kind == "Person"):
                    out.append((x["node"], y["node"]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return near.mapInPandas(agree, "a string, b string")


def link_names(names: DataFrame, *, k: int = 1) -> DataFrame:
    """(id, entity) of the records whose names and aliases tell an entity; equal entity: the same one.

    :param names: id (long), type (``Person`` or ``Organization``), written. A record
        has one row for each of its names; rows may repeat. Null and empty names, and
        those that tell nothing (roles, bare given or family names, numbers, a bare
        business word), link nothing. Further columns are ignored.
    :param k: edits between two spellings of a whole name.

    Full names agree if they have the same words in any order, up to k edits that
    ``same_word`` takes for slips. A short form (initials) belongs to the one entity
    of that word it fits; if it fits several different ones it links nothing; if it
    fits none, equal short forms agree.
    """
    mentions = names.select("id", "type", "written").dropna().distinct()
    node = F.concat_ws("|", F.substring("type", 1, 1), F.when(F.size("words") > 0, F.array_join(F.array_sort("words"), " ")).otherwise(F.concat_ws("|", F.lit("s"), "base", "initials", "middle")))
    parts = materialize(read_mentions(mentions).withColumn("full", F.size("words") > 0).withColumn("node", node), "name_parts")
    told = materialize(mentions.join(parts.select("type", "written", "node", "full"), ["type", "written"]).select("id", "node", "full").distinct(), "name_told")
    full = parts.filter("full").select("type", "node", "words", "names").distinct()

    record = F.concat(F.lit("#"), F.lpad(F.col("id").cast("string"), 20, "0"))
    edges = _close_names(full, k).unionByName(told.filter("full").select(record.alias("a"), F.col("node").alias("b")))
    first = materialize(connected_components(edges), "name_entities")

    # short forms: one entity fits, several fit (then the middle initial may tell), or none
    initial = lambda w: F.substring(w, 1, 1)
    person = F.flatten(F.transform("words", lambda w: F.transform(F.array_except("words", F.array(w)), lambda o: F.struct(w.alias("base"), initial(o).alias("initials")))))
    n = F.size("words")
    acronym = lambda ws: F.array_join(F.transform(ws, initial), "")
    organization = F.array(F.struct(F.element_at("words", 1).alias("base"), acronym(F.slice("words", F.lit(2), n)).alias("initials")), F.struct(F.element_at("words", -1).alias("base"), acronym(F.slice("words", F.lit(1), n - 1)).alias("initials")))
    keyed = parts.filter("full").select("type", "node", "middle", F.explode(F.when(F.col("type") == "Person", person).otherwise(organization)).alias("x")).filter("x.initials <> ''")
    of_full = keyed.join(first, "node").select("type", F.col("x.base").alias("other"), F.col("x.initials").alias("initials"), F.explode(F.array_distinct(F.array(F.lit("*"), "middle"))).alias("middle"), "component")
    fits = materialize(of_full.filter("middle <> ''").groupBy("type", "other", "initials", "middle").agg(F.min("component").alias("low"), F.max("component").alias("high")), "name_fits")
    brief = parts.filter("not full").select("node", "type", "base", "initials", F.explode(F.array_distinct(F.array(F.lit("*"), "middle"))).alias("middle")).distinct()
    bases = segment_join(fits.select("type", F.col("other").alias("base")), "base", ["type"], k, queries=brief.select("type", "base"))
    bases = bases.filter("text_a = text_b or least(length(text_a), length(text_b)) > 5").select("type", F.col("text_a").alias("base"), F.col("text_b").alias("other"))
    found = brief.join(bases, ["type", "base"]).join(fits, ["type", "other", "initials", "middle"])
    exact, by_middle = F.col("other") == F.col("base"), F.col("middle") != "*"
    tiers = [("near", ~by_middle), ("exact", ~by_middle & exact), ("near_middle", by_middle), ("exact_middle", by_middle & exact)]
    fitted = found.groupBy("node").agg(*[x for name, of in tiers for x in (F.min(F.when(of, F.col("low"))).alias(f"{name}_low"), F.max(F.when(of, F.col("high"))).alias(f"{name}_high"))])
    only = lambda name: F.when(F.col(f"{name}_low") == F.col(f"{name}_high"), F.col(f"{name}_low"))
    plain = F.when(F.col("exact_low").isNotNull(), only("exact")).otherwise(only("near"))
    known = fitted.select("node", F.coalesce(plain, only("exact_middle"), only("near_middle")).alias("component"), F.lit(True).alias("seen"))
    loose = told.filter("not full").join(known, "node", "left")
    loose = loose.filter("component is not null or seen is null").select(record.alias("r"), F.coalesce("component", "node").alias("target"))
    ids = first.filter(F.col("node").startswith("#")).select(F.col("node").alias("r"), "component")
    again = loose.join(ids, "r", "left").select(F.coalesce("component", "r").alias("a"), F.col("target").alias("b"))
    second = materialize(connected_components(again), "name_merged")
    every = told.select(record.alias("r"), "id").distinct().join(ids, "r", "left").withColumn("a", F.coalesce("component", "r"))
    return every.join(second.select(F.col("node").alias("a"), F.col("component").alias("m")), "a", "left").select("id", F.coalesce("m", "a").alias("entity"))
