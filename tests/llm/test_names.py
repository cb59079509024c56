from __future__ import annotations

import random

import pytest

from engram.llm.names import edits, fold, link_names, parse, read, segment_join


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def words(n, seed, letters="abc", longest=7):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest + 1))) for _ in range(n)})


def test_banded_distance():
    w = words(60, 1)
    for a in w:
        for b in w:
            for most in (1, 2):
                assert edits(a, b, most) == min(osa(a, b), most + 1)


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_segment_join_finds_all_pairs(spark, hot):
    w = [x for x in words(160, 2) if len(x) > 1]
    df = spark.createDataFrame([(x, "g", i) for i, x in enumerate(w)] + [(w[0], "other", 0), (None, "g", 1), (w[1], "g", 5)], "s string, g string, piece int").drop("piece")
    found = [tuple(r) for r in segment_join(df, "s", ["g"], 1, hot).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {("g", a, b) for a in w for b in w if a < b and osa(a, b) <= 1}


@pytest.mark.parametrize("k", [2, 3])
def test_segment_join_for_any_k(spark, k):
    rng = random.Random(k)
    w = words(40, k, "ab", 6)
    for base in words(25, 9, "abcdefgh", 26):
        x = list(base)
        for _ in range(rng.randrange(1, k + 1)):
            at = rng.randrange(len(x)) if x else 0
            kind = rng.randrange(4)
            if kind == 0 and at + 1 < len(x):
                x[at], x[at + 1] = x[at + 1], x[at]
            elif kind == 1:
                x.insert(at, "z")
            elif x:
                x[at : at + 1] = ["y"] if kind == 2 else []
        w += [base, "".join(x)]
    w = sorted({x for x in w if x})
    found = {(r.text_a, r.text_b) for r in segment_join(spark.createDataFrame([(x, "g") for x in w], "s string, g string"), "s", ["g"], k).collect()}
    assert found == {(a, b) for a in w for b in w if a < b and osa(a, b) <= k}


def test_segment_join_of_queries(spark):
    df = spark.createDataFrame([("g", "abcdefgh", 1), ("g", "abcdxfgh", 2), ("g", "zzzzzzzz", 3), ("h", "abcdefgh", 4)], "g string, s string, n int")
    q = spark.createDataFrame([("g", "abcdefgh"), ("g", "zzzzzzz"), ("g", None)], "g string, s string")
    found = {(r.text_a, r.text_b) for r in segment_join(df, "s", ["g"], 1, queries=q).collect()}
    assert found == {("abcdefgh", "abcdefgh"), ("abcdefgh", "abcdxfgh"), ("zzzzzzz", "zzzzzzzz")}
    pairs = segment_join(df, "s", ["g"], 1, carry=["n"]).collect()
    assert [(r.text_a, r.text_b, r.n_a, r.n_b) for r in pairs] == [("abcdefgh", "abcdxfgh", 1, 2)]


def test_reading_names():
    flat = lambda kind, text: [w for p in reversed(parse(kind, text)) for w, _ in p]
    for text in ("Anthony Valhujuhu", "Tony Valhujuhu", "VALHUJUHU Anthony", "Valhujuhu, Anthony", "Prof. Valhujuhu Tony", "anthony  valhujuhu", "Ａnthony Valhujuhu (on call)"):
        assert sorted(flat("Person", text)) == ["anthony", "valhujuhu"], text
    for text in ("Lorbal Cold Chain Services GmbH", "The Lorbal Cold Chain Svcs group", "lorbal-cold chain svcs", "Services of Cold Chain, Lorbal", "LORBAL COLD CHAIN SERVICES G.m.b.H."):
        assert sorted(flat("Organization", text)) == ["chain", "cold", "lorbal", "services"], text
    plain = lambda *ws: [(w, False, 0, 0) for w in ws]
    assert read("Person", plain("valhujuhu", "a", "b")) == ([], "valhujuhu", "a", "b")
    assert read("Person", plain("avalhujuhu")) == ([], "valhujuhu", "a", "")
    assert read("Organization", [("lorbal", False, 3, 0), ("ccs", True, 0, 0)]) == ([], "lorbal", "ccs", "")
    assert read("Person", []) is None and read("Organization", plain("services")) is None
    assert read("Person", [("contact", False, 9, 9), ("12", False, 1, 0)]) is None
    assert fold("Zoltán\u200bﬁ") == "zoltanfi"


def test_linking(spark):
    rows = [
        (1, "Person", "Anthony Valhujuhu"),
        (2, "Person", "Tony Valhujuu"),
        (2, "Person", "on call"),
        (3, "Person", "A. Valhujuhu"),
        (4, "Person", "Richard Valhujuhu"),
        (5, "Person", "Valhujuhu, R.K."),
        (6, "Person", "Robert K. Valhujuhu"),
        (7, "Person", "R. Valhujuhu"),  # two fit, none is told
        (8, "Person", "the vendor"),
        (9, "Person", None),
        (10, "Organization", "Lorbal Cold Chain Services GmbH"),
        (11, "Organization", "Lorbal CCS"),
        (12, "Organization", "Lorbal Paper Services"),
        (13, "Organization", "Papet Services Lorbal"),
        (14, "Person", "Q. Unknowner"),
        (15, "Person", "Unknowner, Q."),
        (1, "Person", "Anthony Valhujuhu"),
        (None, "Person", "Anthony Valhujuhu"),
        (16, "Person", "x" * 20_000 + " Anthony"),
    ]
    found = link_names(spark.createDataFrame([(*r, "e") for r in rows], "id long, type string, written string, entity string")).collect()
    groups: dict = {}
    for r in found:
        groups.setdefault(r.entity, set()).add(r.id)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset({1, 2, 3}), frozenset({5, 6}), frozenset({10, 11}), frozenset({12, 13}), frozenset({14, 15})}
    assert link_names(spark.createDataFrame([], "id long, type string, written string")).collect() == []


def linked(spark, names, type_):
    """Pairs of names, each the only one of its record, that are linked."""
    rows = [(i, type_, n) for i, n in enumerate(names)]
    groups: dict = {}
    for r in link_names(spark.createDataFrame(rows, "id long, type string, written string")).collect():
        groups.setdefault(r.entity, []).append(names[r.id])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_ordinary_names(spark):
    people = ["Mary Smith", "Mark Smith", "Joan Weber", "John Weber", "Thorsten Bergmann", "Torsten Bergmann", "Wei Zhang", "Zhang Wei", "Mario Rossi", "Maria Rossi", "Daria Rossi", "Paul Klein", "Paula Klein", "Robert Gutierrez", "Bob Guttierrez"]
    assert linked(spark, people, "Person") == {frozenset({"Thorsten Bergmann", "Torsten Bergmann"}), frozenset({"Wei Zhang", "Zhang Wei"}), frozenset({"Robert Gutierrez", "Bob Guttierrez"})}
    firms = ["Siemens AG", "Siemens", "Acme Corp", "Acme Corporation", "Deutsche Bank AG", "Deutsche Bank", "Deutsche Post", "IBM", "I.B.M. Corp", "Area 51 Labs", "Area 52 Labs", "Golden Bakery", "Goldne Bakery", "Services"]
    assert linked(spark, firms, "Organization") == {frozenset({"Siemens AG", "Siemens"}), frozenset({"Acme Corp", "Acme Corporation"}), frozenset({"Deutsche Bank AG", "Deutsche Bank"}), frozenset({"IBM", "I.B.M. Corp"}), frozenset({"Golden Bakery", "Goldne Bakery"})}


def test_another_vocabulary(spark):
    """Names that share no word with any list: recall and precision of planted variants."""
    rng = random.Random(11)
    given = "Akosua Bongani Chidera Dilnoza Eszter Fumiko Gulnara Haruto Ikaika Jorunn Kwabena Lindiwe Mthunzi Nandini Oyelaran Parvaneh Qiuyue Raghnall Sigurdur Takoda".split()
    ends = ["onwe", "arsson", "ukwu", "ashvili", "ienko", "opoulos", "amoto", "enberg"]
    family = sorted({rng.choice(["Ab", "Cor", "Dal", "Ekh", "Fjor", "Gud", "Hav", "Ilm", "Kest", "Lund", "Mor", "Nakh"]) + rng.choice(["ad", "ev", "il", "ol", "un", "ym"]) + rng.choice(ends) for _ in range(90)})
    field = "Bakery Motors Vineyards Ceramics Robotics Seafood Carpets Printing Cinemas Pottery".split()

    def slip(text):
        at = rng.randrange(1, len(text) - 1)
        kind = rng.randrange(4)
        if kind == 0:
            return text[:at] + text[at + 1] + text[at] + text[at + 2 :]
        return text[:at] + (["", rng.choice("etaoinsr"), text[at] * 2][kind - 1]) + text[at + 1 :]

    people = sorted({(rng.choice(given), rng.choice(family)) for _ in range(160)})
    firms = sorted({(rng.choice(family), rng.choice(field)) for _ in range(120)})
    rows, truth = [], {}
    for kind, whole in (("Person", people), ("Organization", firms)):
        for e, (a, b) in enumerate(whole):
            shapes = [f"{a} {b}", f"{b}, {a}" if kind == "Person" else f"{a} {b} Ltd", f"{a} {b}".upper(), f"{b} {a}", slip(f"{a} {b}"), f"Dr {a} {b}" if kind == "Person" else f"The {a} {b} Group"]
            for text in rng.sample(shapes, 3):
                truth[len(rows)] = (kind, e)
                rows.append((len(rows), kind, text))
    groups: dict = {}
    for r in link_names(spark.createDataFrame(rows, "id long, type string, written string")).collect():
        groups.setdefault(r.entity, []).append(r.id)
    found = {(x, y) for g in groups.values() for x in g for y in g if x < y}
    true = {(x, y) for x in truth for y in range(x + 1, min(x + 3, len(rows))) if truth.get(y) == truth[x]}
    recall, precision = len(found & true) / len(true), len(found & true) / len(found)
    print(f"recall {recall:.3f} precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9
