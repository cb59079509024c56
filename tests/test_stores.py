from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from engram.functions import scalar
from engram.sources.collection import Collection, CollectionError, CollectionSchema, FieldDef, evolve
from engram.sources.graph_store import GraphStore

SCHEMA = CollectionSchema((FieldDef("name", "string", optional=False, unique=True, idx=1), FieldDef("age", "bigint", idx=2), FieldDef("score", "double", idx=3)))


def test_documents(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c", SCHEMA)
    assert c.count() == 0 and c.insert(spark.createDataFrame([], "name string")) is None
    assert c.insert(spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "name string, age long").coalesce(1)) == 1
    assert c.update(F.col("age") >= 1, {"age": F.col("age") + 10}, expect_version=1) == 2
    assert c.update(F.col("age") >= 1, {"age": F.col("age")}) is None  # nothing differs
    assert [(r._id, r.name) for r in c.remove(F.col("name") == "b").collect()] == [(2, "b")] and not c.exists(2) and c.exists(1)
    assert {(r.name, r.age) for r in c.read().collect()} == {("a", 11), ("c", None)}
    assert {(r.name, r.age) for r in c.rows.current(1).collect()} == {("a", 1), ("b", 2), ("c", None)}
    for bad in ([(None, 1)], [("a", 5)], [("z", 1), ("z", 2)]):
        with pytest.raises(CollectionError):
            c.insert(spark.createDataFrame(bad, "name string, age long"))
    with pytest.raises(CollectionError):
        c.update(F.lit(True), {"age": F.lit(1)}, expect_version=9)
    with pytest.raises(CollectionError):
        c.update(F.lit(True), {})
    with pytest.raises(CollectionError):
        c.get(77)
    before = {tuple(r) for r in c.read().collect()}
    c.rows.compact()
    assert {tuple(r) for r in c.read().collect()} == before and len(c.rows.commits()) == 1


def test_upgrades():
    more = (*SCHEMA.fields, FieldDef("tag", "string", idx=4))
    assert evolve(SCHEMA, CollectionSchema(more, 2)).version == 2
    for bad in (CollectionSchema(more, 1), CollectionSchema((*SCHEMA.fields, FieldDef("tag", "string", optional=False, idx=4)), 2), CollectionSchema((*SCHEMA.fields, FieldDef("tag", "string", idx=2)), 2), CollectionSchema((FieldDef("name", "bigint", optional=False, unique=True, idx=1),), 2)):
        with pytest.raises(CollectionError):
            evolve(SCHEMA, bad)


def test_graph(spark, tmp_path):
    g = GraphStore(spark, f"file://{tmp_path}/g")
    concepts = "space string, schema_ref string, key string, name string"
    g.create("concepts", spark.createDataFrame([("s", "T", "a", "A"), ("s", "T", "b", "B"), ("s", "T", "c", "C")], concepts).coalesce(1))
    g.upsert_concepts(spark.createDataFrame([("s", "T", "a", "A2"), ("s", "T", "d", "D"), ("s", "T", "d", "D")], concepts))
    assert {(r.id, r.name, r._version) for r in g.read("concepts").collect()} == {("C-1", "A2", 2), ("C-2", "B", 1), ("C-3", "C", 1), ("C-4", "D", 1)}
    tuples = spark.createDataFrame([("s", "C-1", "p", "C-2"), ("s", "C-1", "p", "C-2")], "space string, subject_key string, predicate_ref string, object_key string")
    g.ensure_propositions(tuples)
    g.ensure_propositions(tuples)
    assert g.read("propositions").count() == 1
    g.create("assertions", spark.createDataFrame([("s", "P-1", "support", "stated"), ("s", "P-1", "reject", "stated"), ("s", "P-1", "support", "stated")], "space string, proposition_id string, stance string, mode string").coalesce(1))
    g.supersede(spark.createDataFrame([("A-1", "A-2")], "old string, new string"))
    g.retract(F.col("id") == "A-3")
    assert {(r.id, r.status, r.confidence) for r in g.read("assertions").collect()} == {("A-1", "superseded", -1.0), ("A-2", "active", -1.0), ("A-3", "retracted", -1.0)}
    assert g.update("assertions", F.lit(True), {"confidence": scalar.clamp(scalar.add(F.col("confidence"), 5.0), 0.0, 1.0)}, limit=2)
    assert {r.id for r in g.read("assertions").filter("confidence = 1").collect()} == {"A-1", "A-2"}
    g.merge_concepts(spark.createDataFrame([("C-3", "C-4")], "source string, target string"))
    assert g.merge_concepts(spark.createDataFrame([("C-3", "C-4")], "source string, target string")) is None
    for bad in (("C-4", "C-3"), ("C-3", "C-2"), ("C-2", "C-2")):
        with pytest.raises(CollectionError):
            g.merge_concepts(spark.createDataFrame([bad], "source string, target string"))
    with pytest.raises(CollectionError):
        g.purge("concepts", F.col("id") == "C-2")
    g.set_retention("concepts", F.col("id") == "C-4", "legal_hold")
    with pytest.raises(CollectionError):
        g.purge("concepts", F.col("id") == "C-4", "tombstone_reference")
    g.purge("concepts", F.col("id") == "C-2", "authorized_cascade")
    # what points to the element goes with it, what points to that stays
    assert {(r.id, r.state) for k in ("concepts", "propositions", "assertions") for r in g.read(k).collect()} == {("C-1", "active"), ("C-2", "purged"), ("C-3", "merged"), ("C-4", "active"), ("P-1", "purged"), ("A-1", "active"), ("A-2", "active"), ("A-3", "active")}
    g.archive("concepts", F.col("id") == "C-1")
    g.tombstone("concepts", F.col("id") == "C-4")
    g.create("activities", spark.createDataFrame([("s", "sweep")], "space string, activity_class string"))
    g.transition_activity(F.lit(True), "completed", F.lit("2025-01-01").cast("timestamp"), ["E-1"])
    with pytest.raises(CollectionError):
        g.transition_activity(F.lit(True), "running", F.lit(None).cast("timestamp"))
    with pytest.raises(CollectionError):
        g.create("evidence", spark.createDataFrame([("s",)], "space string"))
    with pytest.raises(ValueError):
        scalar.clamp(F.lit(1), 2, 1)


def test_updates_and_supersessions_reach_the_whole_table(spark, tmp_path):
    from engram.writes import kml_update, named_pairs

    (tmp_path / "d").mkdir()
    rows = [(i, "support", 0.5) for i in range(700)]
    spark.createDataFrame(rows, "_id long, stance string, confidence double").write.parquet(f"file://{tmp_path}/d/assertions.parquet")
    assert kml_update(spark, f"file://{tmp_path}/d").count() == 700
    rows = [("A-1", None, None, ["A-2"]), ("A-2", "active", None, None), ("A-3", "active", ["A-4", "A-3", "A-9"], None), ("A-4", None, None, ["A-8"]), ("A-5", "purged", None, ["A-2"])]
    df = spark.createDataFrame(rows, "id string, state string, supersedes array<string>, superseded_by array<string>")
    assert {(r.old, r.new) for r in named_pairs(df).collect()} == {("A-1", "A-2"), ("A-4", "A-3")}


def _shuffle_files(spark) -> dict:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_few_links_in_a_wide_table_shuffle_few_rows(spark, tmp_path):
    wide = F.array(*[F.sha2(F.concat(F.lit(f"{i}-"), F.col("id").cast("string")), 256) for i in range(20)])
    rows = spark.range(8000).select(F.col("id").alias("_id"), F.lit("active").alias("state"), F.lit("active").alias("status"), wide.alias("evidence_refs"))
    rows.unionByName(rows.filter("_id < 9")).unionByName(rows.filter("_id < 3")).write.parquet(f"file://{tmp_path}/rows")  # ids given two and three times
    before = _shuffle_files(spark)
    g = GraphStore(spark, f"file://{tmp_path}/g")
    g.load("assertions", spark.read.parquet(f"file://{tmp_path}/rows"))
    pairs = [("A-1", "A-2"), ("A-1", "A-3"), ("A-7999", "A-1"), ("A-5", "A-8000"), ("A-06", "A-7"), ("P-8", "A-9"), ("A- 10", "A-9"), ("x", None)]
    assert g.supersede(spark.createDataFrame(pairs, "old string, new string")) == 2
    written = sum(n for f, n in _shuffle_files(spark).items() if f not in before)
    assert written < 8000 * 20 * 64 / 2, f"{written} bytes shuffled"  # less than half of the wide column once
    now = g.read("assertions")
    assert now.count() == now.select("_id").distinct().count() == 8000 and now.filter("size(evidence_refs) <> 20").isEmpty()
    # a key that isn't written as the store writes it names nothing
    hit = {r._id: (r.status, r.superseded_by, r.supersedes) for r in now.filter("_version = 2").select("_id", "status", "superseded_by", "supersedes").collect()}
    assert hit == {1: ("superseded", ["A-2", "A-3"], ["A-7999"]), 2: ("active", None, ["A-1"]), 3: ("active", None, ["A-1"]), 5: ("superseded", ["A-8000"], None), 7: ("active", None, ["A-06"]), 9: ("active", None, ["A- 10", "P-8"]), 7999: ("superseded", ["A-1"], None)}
    with pytest.raises(CollectionError):
        g.supersede(spark.createDataFrame([("A-1", "A-1")], "old string, new string"))
    assert g.supersede(spark.createDataFrame([("A-77777", "A-88888")], "old string, new string")) is None


def test_a_purge_leaves_nothing_behind(spark, tmp_path):
    g = GraphStore(spark, f"file://{tmp_path}/g")
    g.create("concepts", spark.createDataFrame([("s", "T", "a", "Secret"), ("s", "T", "b", "B")], "space string, schema_ref string, key string, name string").coalesce(1))
    g.update("concepts", F.col("id") == "C-1", {"name": F.lit("Secret again")})
    g.create("propositions", spark.createDataFrame([("s", "C-1", "p", "C-2")], "space string, subject_key string, predicate_ref string, object_key string"))
    g.create("assertions", spark.createDataFrame([("s", "P-1", "support", "stated", "legal_hold"), ("s", "P-1", "reject", "stated", None)], "space string, proposition_id string, stance string, mode string, retention string").coalesce(1))
    last = g.log.commits()[-1]
    # a hold on a dependent refuses the whole purge
    with pytest.raises(CollectionError, match="LegalHold"):
        g.purge("propositions", F.lit(True), "authorized_cascade")
    with pytest.raises(CollectionError, match="PurgeDenied"):
        g.purge("concepts", F.col("id") == "C-1")
    assert g.log.commits()[-1] == last and {r.state for k in ("concepts", "propositions", "assertions") for r in g.read(k).collect()} == {"active"}
    assert g.purge("concepts", F.col("id") == "C-1", "tombstone_reference") == last + 1
    stub = g.read("concepts").filter("id = 'C-1'").first()
    assert stub.state == "purged" and stub.name is None and len(stub.purged_digest) == 64 and stub._version == 3
    assert {r.id for r in g.read("concepts", last).collect()} == {"C-2"}
    names = {r.name for f in (tmp_path / "g/concepts").iterdir() for r in spark.read.parquet(f"file://{f}").select("name").collect()}
    assert names == {None, "B"}
    assert g.read("propositions").filter("state = 'active'").count() == 1
    assert g.purge("concepts", F.col("id") == "C-1", "tombstone_reference") is None
    with pytest.raises(CollectionError):
        g.purge("concepts", F.lit(True), "at_once")


def test_transactions_are_all_or_nothing(spark, tmp_path):
    g = GraphStore(spark, f"file://{tmp_path}/g")
    concepts = lambda *names: spark.createDataFrame([("s", "T", n, n) for n in names], "space string, schema_ref string, key string, name string").coalesce(1)
    with g.transaction() as t:
        g.create("concepts", concepts("a", "b"))
        g.create("propositions", spark.createDataFrame([("s", "C-1", "p", "C-2")], "space string, subject_key string, predicate_ref string, object_key string"))
        g.update("concepts", F.col("key") == "a", {"name": F.lit("A")})
    assert t == {"seq": 1, "written": {"concepts": 2, "propositions": 1}}
    assert {(r.name, r._version) for r in g.read("concepts").collect()} == {("A", 1), ("b", 1)}
    with pytest.raises(CollectionError):
        with g.transaction():
            g.create("concepts", concepts("c"))
            g.create("concepts", spark.createDataFrame([("s",)], "space string"))
    with g.transaction(dry_run=True) as t:
        g.create("concepts", concepts("c", "d"))
    assert t == {"seq": None, "written": {"concepts": 2}} and g.log.commits() == [1]
    with pytest.raises(CollectionError, match="CommitConflict"):
        with g.transaction():
            g.create("concepts", concepts("c"))
            GraphStore(spark, f"file://{tmp_path}/g").create("concepts", concepts("e"))
    assert {r.key for r in g.read("concepts").collect()} == {"a", "b", "e"}
    with g.transaction() as t:
        g.update("concepts", F.col("key") == "nobody", {"name": F.lit("x")})
    assert t["seq"] is None and g.log.commits() == [1, 2]
