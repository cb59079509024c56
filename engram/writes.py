"""Registered queries of the write side: update expressions and clauses on versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import scalar
from engram.plans.session import Session
from engram.runtime import scratch_path, table
from engram.sources.graph_store import GraphStore
from engram.sources.store import live


def update_exprs(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("confidence") >= 0, F.col("confidence"))
    new = scalar.clamp(scalar.mul(scalar.add(scalar.coalesce(c, F.lit(0.5)), 0.1), 1.2), 0.2, 0.9)
    return table(spark, d, "assertions").dropDuplicates(["_id"]).select("_id", F.round(new, 6).alias("confidence"))


def _store(spark: SparkSession, d: str, *kinds: str) -> GraphStore:
    g = GraphStore(spark, scratch_path(spark, "graph"))
    for k in kinds:
        g.load(k, table(spark, d, k))
    return g


def kml_archive(spark: SparkSession, d: str) -> DataFrame:
    g = _store(spark, d, "concepts")
    g.archive("concepts", F.element_at(F.split("schema_ref", "/"), -1) == "Place")
    return g.read("concepts").groupBy("state", F.col("_version").alias("version")).agg(F.count("*").alias("n"))


def _raised(spark: SparkSession, d: str, limit: int | None) -> DataFrame:
    g = _store(spark, d, "assertions")
    g.update("assertions", (F.col("stance") == "support") & (F.col("confidence") >= 0), {"confidence": scalar.clamp(scalar.add(F.col("confidence"), 0.25), 0.0, 1.0)}, limit=limit)
    return g.read("assertions").filter("_version = 2").select("_id", F.round("confidence", 6).alias("confidence"))


def kml_update(spark: SparkSession, d: str) -> DataFrame:
    return _raised(spark, d, None)


def kml_update_limit(spark: SparkSession, d: str) -> DataFrame:
    """The same with the clause LIMIT 500."""
    return _raised(spark, d, 500)


def named_pairs(assertions: DataFrame) -> DataFrame:
    """(old, new) of supersessions that either assertion of the two names, whatever its status; both there and no purged stubs."""
    own = live(assertions)
    sides = F.array(F.struct(F.lit(True).alias("up"), F.col("superseded_by").alias("keys")), F.struct(F.lit(False).alias("up"), F.col("supersedes").alias("keys")))
    # one pass over the lists for both directions; the record that names is there, so only the named one is looked up
    naming = own.filter("size(superseded_by) > 0 or size(supersedes) > 0").select(F.col("id").alias("me"), F.inline(sides)).select("me", "up", F.explode("keys").alias("id"))
    met = naming.filter("me <> id").join(own.select("id"), "id", "left_semi")
    return met.select(F.when(F.col("up"), F.col("me")).otherwise(F.col("id")).alias("old"), F.when(F.col("up"), F.col("id")).otherwise(F.col("me")).alias("new")).distinct()


def kml_supersede(spark: SparkSession, d: str) -> DataFrame:
    g = _store(spark, d, "assertions")
    g.supersede(named_pairs(g.read("assertions")))
    return g.read("assertions").filter("_version = 2").groupBy("status").agg(F.count("*").alias("n"), F.sum((F.size("superseded_by") > 0).cast("long")).alias("replaced"))


def _session(spark: SparkSession, d: str, *kinds: str) -> Session:
    path = scratch_path(spark, "session")
    g = GraphStore(spark, path)
    for k in kinds:
        g.load(k, table(spark, d, k))
    return Session(spark, path)


def kml_text_update(spark: SparkSession, d: str) -> DataFrame:
    """An update whose values are computed from each concept's own attributes."""
    s = _session(spark, d, "concepts")
    s.mutate('UPDATE ?c SET ATTRIBUTES { rank: CLAMP(ADD(?c.attributes.rank, 3), 0, 9) } WHERE { ?c CONCEPT {type: "Topic"} FILTER(IS_NOT_NULL(?c.attributes.rank)) }')
    rows = s.store.read("concepts").filter("_version = 2")
    return rows.select("_id", F.get_json_object("attributes", "$.rank").cast("double").alias("rank"), F.get_json_object("attributes", "$.note").alias("note"))


def kml_text_retract(spark: SparkSession, d: str) -> DataFrame:
    s = _session(spark, d, "assertions")
    s.mutate('RETRACT ASSERTION ?a WHERE { ?a ASSERTION {mode: "inferred"} FILTER(?a.confidence < 0.5) }')
    return s.store.read("assertions").groupBy("status", F.col("_version").alias("version")).agg(F.count("*").alias("n"))


def kml_text_archive(spark: SparkSession, d: str) -> DataFrame:
    """A selection over a join: the things that something depends on, the first hundred of them."""
    s = _session(spark, d, "concepts", "propositions")
    s.mutate('ARCHIVE ?c WHERE { ?p PROPOSITION (?x, "depends_on", ?c) ?c CONCEPT {} } LIMIT 100')
    return s.store.read("concepts").filter("_version = 2").select("_id", "state")


def kml_merge(spark: SparkSession, d: str) -> DataFrame:
    """All active routines without a survivor become the oldest of their space."""
    g = _store(spark, d, "concepts")
    rows = g.read("concepts").filter((F.element_at(F.split("schema_ref", "/"), -1) == "Routine") & (F.col("state") == "active") & F.expr("coalesce(merged_into, '') = '' and space is not null"))
    oldest = rows.groupBy("space").agg(F.min_by("id", "_id").alias("target"))
    g.merge_concepts(rows.join(oldest, "space").select(F.col("id").alias("source"), "target").filter("source <> target"))
    return g.read("concepts").filter("_version = 2").select("_id", "merged_into", "state")


def kml_purge(spark: SparkSession, d: str) -> DataFrame:
    """Versions that are left after active devices were archived and then erased."""
    g = _store(spark, d, "concepts")
    device = F.element_at(F.split("schema_ref", "/"), -1) == "Device"
    g.archive("concepts", device)
    g.purge("concepts", device & (F.col("state") == "archived"), "tombstone_reference")
    log = g.tables["concepts"].log()
    return log.groupBy("state", F.col("_version").alias("version")).agg(F.count("*").alias("n"), F.count("name").alias("names"))


def kml_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The table before its second commit."""
    g = _store(spark, d, "concepts")
    g.tombstone("concepts", F.col("state") == "archived")
    return g.read("concepts", 1).groupBy("state").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {f.__name__: f for f in (update_exprs, kml_archive, kml_update, kml_update_limit, kml_supersede, kml_text_update, kml_text_retract, kml_text_archive, kml_merge, kml_purge, kml_as_of)}


def oracle_sql() -> dict[str, str]:
    raised = "WITH a AS (SELECT DISTINCT ON (_id) * FROM assertions), h AS (SELECT * FROM a WHERE stance = 'support' AND confidence >= 0{limit}) SELECT _id, round(least(confidence + 0.25, 1), 6) AS confidence FROM h WHERE least(confidence + 0.25, 1) <> confidence"
    return {
        "update_exprs": "SELECT DISTINCT ON (_id) _id, round(least(greatest((coalesce(CASE WHEN confidence >= 0 THEN confidence END, 0.5) + 0.1) * 1.2, 0.2), 0.9), 6) AS confidence FROM assertions",
        "kml_archive": "WITH c AS (SELECT DISTINCT ON (_id) * FROM concepts), u AS (SELECT state = 'active' AND schema_ref LIKE '%/Place' AS hit, state FROM c) SELECT CASE WHEN hit THEN 'archived' ELSE state END AS state, CASE WHEN hit THEN 2 ELSE 1 END AS version, count(*) AS n FROM u GROUP BY ALL",
        "kml_update": raised.format(limit=""),
        "kml_update_limit": raised.format(limit=" ORDER BY _id LIMIT 500"),
        "kml_supersede": """WITH a AS (SELECT DISTINCT ON (_id) 'A-' || _id AS id, * FROM assertions), lv AS (SELECT * FROM a WHERE coalesce(state, '') <> 'purged'),
 pr AS (SELECT o, n FROM (SELECT id AS o, unnest(superseded_by) AS n FROM lv UNION SELECT unnest(supersedes), id FROM lv) WHERE o <> n AND o IN (SELECT id FROM lv) AND n IN (SELECT id FROM lv)),
 f AS (SELECT o, list(DISTINCT n) AS ns FROM pr GROUP BY o), b AS (SELECT n, list(DISTINCT o) AS os FROM pr GROUP BY n),
 x AS (SELECT CASE WHEN f.o IS NOT NULL THEN 'superseded' ELSE status END AS status, status AS was, CASE WHEN f.o IS NOT NULL THEN list_sort(list_distinct(list_concat(coalesce(superseded_by, []), ns))) ELSE superseded_by END AS forward, superseded_by, CASE WHEN b.n IS NOT NULL THEN list_sort(list_distinct(list_concat(coalesce(supersedes, []), os))) ELSE supersedes END AS back, supersedes FROM a LEFT JOIN f ON f.o = a.id LEFT JOIN b ON b.n = a.id)
 SELECT status, count(*) AS n, count(*) FILTER (len(forward) > 0) AS replaced FROM x WHERE status IS DISTINCT FROM was OR forward IS DISTINCT FROM superseded_by OR back IS DISTINCT FROM supersedes GROUP BY status""",
        "kml_text_update": "SELECT DISTINCT ON (_id) _id, least(greatest(r + 3, 0), 9) AS rank, json_extract_string(attributes, '$.note') AS note FROM (SELECT *, TRY_CAST(json_extract(attributes, '$.rank') AS DOUBLE) AS r FROM concepts WHERE schema_ref LIKE '%/Topic' AND state = 'active') WHERE r < 9",
        "kml_text_retract": "SELECT CASE WHEN hit THEN 'retracted' ELSE status END AS status, CASE WHEN hit THEN 2 ELSE 1 END AS version, count(*) AS n FROM (SELECT status, coalesce(state = 'active' AND status = 'active' AND mode = 'inferred' AND confidence >= 0 AND confidence < 0.5, false) AS hit FROM (SELECT DISTINCT ON (_id) * FROM assertions)) GROUP BY ALL",
        "kml_text_archive": "WITH g AS (SELECT CASE WHEN object_key LIKE 'id' || chr(31) || '%' THEN substr(object_key, 4) ELSE object_key END AS o FROM propositions WHERE state = 'active' AND predicate_ref LIKE '%/depends_on') SELECT DISTINCT _id, 'archived' AS state FROM concepts WHERE state = 'active' AND 'C-' || _id IN (SELECT o FROM g) ORDER BY _id LIMIT 100",
        "kml_merge": "WITH r AS (SELECT DISTINCT ON (_id) _id, space FROM concepts WHERE schema_ref LIKE '%/Routine' AND state = 'active' AND coalesce(merged_into, '') = '' AND space IS NOT NULL), t AS (SELECT space, min(_id) AS t FROM r GROUP BY space) SELECT _id, 'C-' || t AS merged_into, 'merged' AS state FROM r JOIN t USING (space) WHERE _id <> t",
        "kml_purge": """WITH c AS (SELECT DISTINCT ON (_id) *, coalesce(schema_ref LIKE '%/Device', false) AS dev FROM concepts), h AS (SELECT *, dev AND state IN ('active', 'archived') AS gone FROM c)
 SELECT CASE WHEN gone THEN 'purged' ELSE state END AS state, CASE WHEN NOT gone THEN 1 WHEN state = 'active' THEN 3 ELSE 2 END AS version, count(*) AS n, count(CASE WHEN NOT gone THEN name END) AS names FROM h GROUP BY ALL""",
        "kml_as_of": "SELECT state, count(*) AS n FROM (SELECT DISTINCT ON (_id) * FROM concepts) GROUP BY state",
    }
