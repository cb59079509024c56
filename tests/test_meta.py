from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from engram.operators import belief, history
from engram.operators.capsule import export, import_, verify
from engram.operators.governance import Statement, authorize
from engram.plans import meta
from engram.plans.language import QueryError
from engram.plans.session import Session
from engram.sources.collection import CollectionError
from engram.sources.graph_store import GraphStore

SETUP = """MUTATE {
  CREATE CONCEPT ?ann { TYPE "pkg/people/Person" NAME "Ann Tea" SET FIELDS {key: "ann", canonical_id: "urn:ann"} SET FACET "Mood" {level: 1} SET STRUCTURAL { ("friends", ?bob) } }
  CREATE CONCEPT ?bob { TYPE "pkg/people/Person" NAME "Bob" }
  CREATE CONCEPT ?tea { TYPE "pkg/things/Drink" NAME "green tea" }
  ENSURE PROPOSITION ?p (?ann, "pkg/things/likes", ?tea)
  CREATE EVIDENCE ?e { SET FIELDS { evidence_class: "note", payload: "tea was drunk, tea was good" } }
  CREATE ASSERTION ?a { SET FIELDS { proposition: ?p, asserted_by: ?ann, stance: "uncertain", mode: "stated" } SET STRUCTURAL { ("evidence", ?e) } }
}"""


@pytest.fixture
def session(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/g", "one")
    s.mutate(SETUP)
    return s


def test_search_lists_and_descriptions(session):
    s = session
    found = meta.search(s.view, "tea").collect()
    assert {(r.id, r.kind) for r in found} == {("C-1", "concept"), ("C-3", "concept"), ("E-1", "evidence")} and [r.score for r in found] == sorted((r.score for r in found), reverse=True)
    assert [r.id for r in meta.search(s.view, "tea AND NOT ann", "CONCEPT").collect()] == ["C-3"] and [r.id for r in meta.search(s.view, "tea", type="Person").collect()] == ["C-1"]
    assert [r.id for r in meta.search(s.view, "likes", predicate="likes").collect()] == ["P-1"] and meta.search(s.view, "tea", threshold=99).collect() == [] and meta.search(s.view, "tea", limit=1, offset=2).count() == 1
    for args, code in ((("tea", "ASSERTION"), "SearchIndexUnavailable"),):
        with pytest.raises(QueryError) as e:
            meta.search(s.view, *args)
        assert e.value.code == code
    with pytest.raises(QueryError):
        meta.search(s.view, "tea", mode="semantic")
    listed = {t: {(r.name, r.n) for r in meta.list_(s.view, t).collect()} for t in ("SPACES", "SCHEMA_PACKAGES", "TYPES", "PREDICATES", "FACETS")}
    assert listed == {"SPACES": {("one", 6)}, "SCHEMA_PACKAGES": {("pkg/people", 2), ("pkg/things", 2)}, "TYPES": {("Person", 2), ("Drink", 1)}, "PREDICATES": {("likes", 1)}, "FACETS": {("Mood", 1)}}
    assert ("friends", 1) in {tuple(r) for r in meta.list_(s.view, "STRUCTURAL_FIELDS").collect()} and meta.list_(s.view, "EPISTEMIC_POLICIES", limit=1, offset=1).count() == 1
    assert {tuple(r) for r in meta.counts(s.view).collect()} == {("concept", 3), ("proposition", 1), ("assertion", 1), ("evidence", 1), ("activity", 0)}
    assert meta.describe(s.view, "SPACE", "one")["elements"]["concept/active"] == 3 and meta.describe(s.view, "TYPE", "Drink")["symbols"] == {"pkg/things/Drink": 1}
    assert meta.describe(s.view, "POLICY")["accept"] == 0.7 and "name" in meta.describe(s.view, "KIND", "CONCEPT")["paths"] and meta.describe(s.view, "PROTOCOL")["kinds"] and meta.describe(s.view, "CAPABILITIES")["missing_stages"]
    for bad in (("TYPE", "Ship"), ("POLICY", "strict"), ("NOTHING", None)):
        with pytest.raises(QueryError):
            meta.describe(s.view, *bad)


def test_validation_and_batches(session):
    assert meta.validate("FIND(?c.id) WHERE { ?c CONCEPT {} }")["valid"] and not meta.validate("FIND(?c.id)")["valid"]
    assert meta.validate('ARCHIVE "C-1"', "READ")["error"] == "LanguageMismatch"
    ops = [("FIND(COUNT(?c)) WHERE { ?c CONCEPT {} }", None), ('ARCHIVE "C-99"', None), ('ARCHIVE "C-2"', None)]
    out = meta.batch(session, ops, "sequence")
    assert out[0]["result"].first()[0] == 3 and [x.get("error") for x in out[1:]] == ["NotFoundOrNotVisible", "Skipped"]
    assert [x.get("error") for x in meta.batch(session, ops)] == [None, "NotFoundOrNotVisible", None]
    for bad in ((ops * 100, "independent"), (ops, "atomic")):
        with pytest.raises(QueryError):
            meta.batch(session, *bad)


def test_authorization(spark):
    fs = frozenset
    some = [Statement(True, fs({"ann"}), fs({"read"}), fs({"CONCEPT"}), fs({"one", "two"}), mask=fs({("attributes",)}), max_results=5), Statement(True, None, fs({"read"}), fs({"CONCEPT"}), fs({"three"}), where="state = 'active'", mask=fs({("attributes",), ("name",)}), max_results=9), Statement(False, spaces=fs({"two"}))]
    rows = spark.createDataFrame([("one", "active"), ("two", "active"), ("three", "active"), ("three", "archived"), (None, "active"), ("three", None)], "space string, state string")
    seen = lambda a, k="CONCEPT": sorted(tuple(r) for r in rows.filter(a.visible[k]).collect())
    ann = authorize(some, "ann")
    assert seen(ann) == [("one", "active"), ("three", "active")] and ann.masked == {"CONCEPT": {("attributes",)}} and ann.max_results == 9
    assert seen(authorize(some, "bob")) == [("three", "active")] and seen(authorize(some, "ann"), "EVIDENCE") == [] and seen(authorize(some, "ann", "purge")) == [] and seen(authorize([], "ann")) == []


def test_capsules(spark, session, tmp_path):
    rows, digest = export(session.store, spark.createDataFrame([("A-1",)], "id string"))
    assert {r.id for r in rows.collect()} == {"A-1", "P-1", "E-1", "C-1", "C-3"} and verify(rows, digest) and not verify(rows.filter("id <> 'C-1'"), digest)
    other = GraphStore(spark, f"file://{tmp_path}/other")
    other.create("concepts", spark.createDataFrame([("two", "T", "x", "X", None), ("two", "T", "ann", "Ann", "urn:ann")], "space string, schema_ref string, key string, name string, canonical_id string").coalesce(1))
    pairs = {r.old: r.new for r in import_(other, rows, digest, space="two", isolate=True).collect()}
    assert pairs["C-1"] == "C-2" and pairs["C-3"] == "C-3" and pairs["P-1"] == "P-1" and other.log.commits() == [1, 2]
    p, a = other.read("propositions").first(), other.read("assertions").first()
    assert p.subject_key.endswith("C-2") and p.object_key.endswith("C-3") and p.state == "quarantined" and p.space == "two" and a.proposition_id == "P-1" and a.evidence_refs == ["E-1"] and a.asserted_by_key.endswith("C-2")
    again = {r.old: r.new for r in import_(other, rows, digest, space="two").collect()}
    assert again["C-1"] == "C-2" and again["C-3"] == "C-4"
    with pytest.raises(CollectionError):
        import_(other, rows.filter("id <> 'C-1'"), digest, space="two")
    with pytest.raises(CollectionError):
        export(session.store, spark.createDataFrame([], "id string"))


def test_uncertain_claims_engage(spark, session):
    b = session.query('FIND(?b.status, ?b.support.score) WHERE { ?p PROPOSITION (?s, "likes", ?o) ?b BELIEF (?p) }').collect()
    assert [tuple(r) for r in b] == [("uncertain", 0.0)]
    u = belief.uncertainty(session.view.beliefs(belief.BASELINE, F.lit("2025-01-01").cast("timestamp"))).first()
    assert u.level == "high" and u.reasons == ["no_eligible_claim", "uncertain_claims"]


def test_history_helpers(spark):
    packages = spark.createDataFrame([("a", "1", 1), ("a", "2", 5), ("b", "1", 9)], "package string, version string, from_seq long")
    assert {tuple(r) for r in history.schema_at(packages, 6).collect()} == {("a", "2")}
    journal = spark.createDataFrame([("s", 4)], "space string, seq long")
    assert history.bound(journal, history.snapshot(journal, "s", 3), 3) == ("s", 3)
    for bad in (("s:3", 2), ("s:9", None), ("junk", None)):
        with pytest.raises(history.HistoryError):
            history.bound(journal, *bad)
