"""Registered queries of the graph layer: the read language, history, belief, governance, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import belief, bm25, history
from engram.operators.governance import Statement, authorize
from engram.operators.hierarchy import CYCLE, hierarchy
from engram.operators.traverse import walk
from engram.plans import meta
from engram.plans.compile import run
from engram.plans.store_view import StoreView
from engram.runtime import table
from engram.sources.store import key_of, live, present

_AT = "2025-06-01T00:00:00Z"

#: name -> (query, SQL over the views c p a e x of distinct records and g of active propositions)
_LANGUAGE: dict[str, tuple[str, str | None]] = {
    "pat_element": ('FIND(?c.id, ?c.name) WHERE { ?c CONCEPT {type: "Service"} }', "SELECT id AS c_id, name AS c_name FROM c WHERE type = 'Service' AND state = 'active'"),
    "pat_element_state": ('FIND(?c.id) WHERE { ?c CONCEPT {state: "archived", type: ["Place", "Topic"]} }', "SELECT id AS c_id FROM c WHERE state = 'archived' AND type IN ('Place', 'Topic')"),
    "pat_element_id": ('FIND(?c.id, ?c.kind, ?c.lifecycle.state) WHERE { ?c CONCEPT "C-12" }', "SELECT id AS c_id, 'concept' AS c_kind, state AS c_lifecycle_state FROM c WHERE id = 'C-12'"),
    "pat_field_binding": ('FIND(?a.id, ?who) WHERE { ?a ASSERTION {stance: "reject", asserted_by: ?who} }', "SELECT id AS a_id, substr(asserted_by_key, 4) AS who FROM a WHERE state = 'active' AND stance = 'reject' AND asserted_by_key IS NOT NULL"),
    "pat_tuple": ('FIND(?p.id, ?s, ?o) WHERE { ?p PROPOSITION (?s, "depends_on", ?o) }', "SELECT p AS p_id, s, o FROM g WHERE pred = 'depends_on'"),
    "pat_tuple_names": ('FIND(?s.name, ?o.name) WHERE { ?p PROPOSITION (?s, "depends_on", ?o) ?s CONCEPT {type: "Service"} }', "SELECT s.name AS s_name, o.name AS o_name FROM g JOIN c s ON s.id = g.s AND s.type = 'Service' AND s.state = 'active' LEFT JOIN c o ON o.id = g.o WHERE pred = 'depends_on'"),
    "pat_alternation": ('FIND(?s, ?o) WHERE { ?p PROPOSITION (?s, "depends_on" | "part_of", ?o) }', "SELECT s, o FROM g WHERE pred IN ('depends_on', 'part_of')"),
    "pat_predicate_var": ('FIND(?s.id, ?k) WHERE { ?p PROPOSITION (?s, ?k, ?o) ?s CONCEPT {type: "Organization"} }', "SELECT g.s AS s_id, pred AS k FROM g JOIN c ON c.id = g.s AND type = 'Organization' AND state = 'active'"),
    "pat_prop_id": ('FIND(?p.predicate, ?p.subject) WHERE { ?p PROPOSITION "P-7" }', "SELECT pred AS p_predicate, substr(subject_key, 4) AS p_subject FROM p WHERE id = 'P-7'"),
    "pat_structural": ('FIND(?a, ?e.id) WHERE { STRUCTURAL (?a, "evidence", ?e) ?e EVIDENCE {evidence_class: "report"} }', "SELECT DISTINCT r.k AS a, r.t AS e_id FROM (SELECT a.id AS k, unnest(evidence_refs) AS t0, CASE WHEN t0 LIKE '{%' THEN coalesce(json_extract_string(t0, '$.evidence_id'), json_extract_string(t0, '$.id')) ELSE t0 END AS t FROM a WHERE state = 'active') r JOIN e ON e.id = r.t WHERE e.evidence_class = 'report' AND e.state = 'active'"),
    "kql_join": ('FIND(?a.id, ?s, ?o) WHERE { ?p PROPOSITION (?s, "status", ?o) ?a ASSERTION {proposition: ?p, stance: "support"} }', "SELECT a.id AS a_id, g.s, g.o FROM g JOIN a ON a.proposition_id = g.p WHERE pred = 'status' AND stance = 'support' AND a.state = 'active'"),
    "kql_cross": ('FIND(?x.id, ?y.id) WHERE { ?x CONCEPT {type: "Agent"} ?y CONCEPT {type: "Place", state: "archived"} }', "SELECT x.id AS x_id, y.id AS y_id FROM c x, c y WHERE x.type = 'Agent' AND x.state = 'active' AND y.type = 'Place' AND y.state = 'archived'"),
    "kql_optional": ('FIND(?c.id, ?o) WHERE { ?c CONCEPT {type: "Device"} OPTIONAL { ?p PROPOSITION (?c, "part_of", ?o) } }', "SELECT c.id AS c_id, g.o FROM c LEFT JOIN g ON g.s = c.id AND pred = 'part_of' WHERE c.type = 'Device' AND c.state = 'active'"),
    "kql_optional_join": ('FIND(?c.id, ?o, ?t.name) WHERE { ?c CONCEPT {type: "Device"} OPTIONAL { ?p PROPOSITION (?c, "part_of", ?o) } ?t CONCEPT {type: "Agent"} FILTER(IS_NULL(?o) || STARTS_WITH(?o, "C-1")) }', "SELECT c.id AS c_id, g.o, t.name AS t_name FROM c LEFT JOIN g ON g.s = c.id AND pred = 'part_of', c t WHERE c.type = 'Device' AND c.state = 'active' AND t.type = 'Agent' AND t.state = 'active' AND (g.o IS NULL OR g.o LIKE 'C-1%')"),
    "kql_not": ('FIND(?c.id) WHERE { ?c CONCEPT {type: "Service"} NOT { ?p PROPOSITION (?c, "depends_on", ?o) } }', "SELECT id AS c_id FROM c WHERE type = 'Service' AND state = 'active' AND id NOT IN (SELECT s FROM g WHERE pred = 'depends_on')"),
    "kql_not_unshared": ('FIND(?c.id) WHERE { ?c CONCEPT {type: "Service"} NOT { ?t CONCEPT {type: "Agent"} } }', "SELECT id AS c_id FROM c WHERE type = 'Service' AND state = 'active' AND NOT EXISTS (SELECT 1 FROM c t WHERE t.type = 'Agent' AND t.state = 'active')"),
    "kql_not_unshared_none": ('FIND(?c.id) WHERE { ?c CONCEPT {type: "Service"} NOT { ?t CONCEPT {type: "Robot"} } }', "SELECT id AS c_id FROM c WHERE type = 'Service' AND state = 'active' AND NOT EXISTS (SELECT 1 FROM c t WHERE t.type = 'Robot' AND t.state = 'active')"),
    "kql_union": ('FIND(?c.id) WHERE { ?c CONCEPT {type: "Agent"} UNION { ?c CONCEPT {type: "Topic"} } }', "SELECT id AS c_id FROM c WHERE type IN ('Agent', 'Topic') AND state = 'active'"),
    "f_cmp": ('FIND(?a.id) WHERE { ?a ASSERTION {} FILTER(?a.confidence >= 0.8 && ?a.mode != "stated") }', "SELECT id AS a_id FROM a WHERE state = 'active' AND confidence >= 0.8 AND mode <> 'stated'"),
    "f_cmp_unlike": ('FIND(?c.id) WHERE { ?c CONCEPT {type: "Agent"} FILTER(!(?c.name > 5) && ?c.name != 5) }', "SELECT id AS c_id FROM c WHERE type = 'Agent' AND state = 'active' AND name IS NOT NULL"),
    "f_not_null": ('FIND(?a.id) WHERE { ?a ASSERTION {} FILTER(!(?a.confidence > 0.2)) }', "SELECT id AS a_id FROM a WHERE state = 'active' AND NOT coalesce(confidence > 0.2 AND confidence >= 0, false)"),
    "f_attribute": ('FIND(?c.id, ?c.attributes.note) WHERE { ?c CONCEPT {} FILTER(?c.attributes.rank >= 7) }', "SELECT id AS c_id, to_json(json_extract_string(attributes, '$.note'))::VARCHAR AS c_attributes_note FROM c WHERE state = 'active' AND TRY_CAST(json_extract(attributes, '$.rank') AS DOUBLE) >= 7"),
    "f_contains": ('FIND(?c.id) WHERE { ?c CONCEPT {} FILTER(CONTAINS(?c.name, "or")) }', "SELECT id AS c_id FROM c WHERE state = 'active' AND contains(name, 'or')"),
    "f_starts_with": ('FIND(?c.id) WHERE { ?c CONCEPT {} FILTER(STARTS_WITH(?c.name, "A")) }', "SELECT id AS c_id FROM c WHERE state = 'active' AND starts_with(name, 'A')"),
    "f_ends_with": ('FIND(?c.id) WHERE { ?c CONCEPT {} FILTER(ENDS_WITH(?c.name, "en")) }', "SELECT id AS c_id FROM c WHERE state = 'active' AND ends_with(name, 'en')"),
    "f_regex": ('FIND(?c.id) WHERE { ?c CONCEPT {} FILTER(REGEX(?c.name, "^[A-C].*(en|or)$")) }', "SELECT id AS c_id FROM c WHERE state = 'active' AND regexp_matches(name, '^[A-C].*(en|or)$')"),
    "f_in": ('FIND(?a.id) WHERE { ?a ASSERTION {} FILTER(IN(?a.mode, ["observed", "inferred"])) }', "SELECT id AS a_id FROM a WHERE state = 'active' AND mode IN ('observed', 'inferred')"),
    "f_is_null": ('FIND(?a.id) WHERE { ?a ASSERTION {} FILTER(IS_NULL(?a.valid_until) && IS_NOT_NULL(?a.valid_from)) }', "SELECT id AS a_id FROM a WHERE state = 'active' AND valid_until IS NULL AND valid_from IS NOT NULL"),
    "f_kinds": ('FIND(?p.id, ?o) WHERE { ?p PROPOSITION (?s, ?k, ?o) FILTER(IS_LITERAL(?o) && LITERAL_TYPE(?o, "number")) }', "SELECT p AS p_id, o FROM g WHERE starts_with(o, 'lit' || chr(31) || 'number')"),
    "f_is_element": ('FIND(?p.id) WHERE { ?p PROPOSITION (?s, ?k, ?o) FILTER(IS_ELEMENT(?o) && IS_KIND(?o, "concept")) }', "SELECT p AS p_id FROM g WHERE starts_with(o, 'C-')"),
    "agg_count": ('FIND(COUNT(?c), COUNT(DISTINCT ?c.name), COUNT(?c.canonical_id)) WHERE { ?c CONCEPT {} }', "SELECT count(id) AS count_c, count(DISTINCT name) AS count_distinct_c_name, count(canonical_id) AS count_c_canonical_id FROM c WHERE state = 'active'"),
    "agg_sum": ('FIND(SUM(?a.confidence), AVG(?a.confidence), MIN(?a.confidence), MAX(?a.confidence)) WHERE { ?a ASSERTION {stance: "support"} }', "SELECT coalesce(sum(confidence), 0) AS sum_a_confidence, avg(confidence) AS avg_a_confidence, min(confidence) AS min_a_confidence, max(confidence) AS max_a_confidence FROM a WHERE state = 'active' AND stance = 'support' AND confidence >= 0"),
    "agg_none": ('FIND(COUNT(?c), SUM(?c.version), AVG(?c.version)) WHERE { ?c CONCEPT {name: "Nobody"} }', "SELECT 0 AS count_c, 0.0 AS sum_c_version, NULL::DOUBLE AS avg_c_version"),
    "order_by": ('FIND(?a.id, ?a.confidence) WHERE { ?a ASSERTION {mode: "observed"} } ORDER BY ?a.confidence DESC, ?a.id LIMIT 40', "SELECT id AS a_id, CASE WHEN confidence >= 0 THEN confidence END AS a_confidence FROM a WHERE state = 'active' AND mode = 'observed' ORDER BY 2 DESC NULLS LAST, id LIMIT 40"),
    "order_by_nulls_last": ('FIND(?c.id, ?c.canonical_id) WHERE { ?c CONCEPT {type: "Place"} } ORDER BY ?c.canonical_id ASC LIMIT 50', "SELECT id AS c_id, canonical_id AS c_canonical_id FROM c WHERE state = 'active' AND type = 'Place' ORDER BY canonical_id NULLS LAST, id LIMIT 50"),
    "limit_cursor": ('FIND(?c.id) WHERE { ?c CONCEPT {} } ORDER BY ?c.name LIMIT 15 CURSOR 30', "SELECT id AS c_id FROM c WHERE state = 'active' ORDER BY name NULLS LAST, id LIMIT 15 OFFSET 30"),
    "for_time": (f'FIND(?a.id) WHERE {{ ?a ASSERTION {{stance: "support"}} }} FOR TIME "{_AT}"', f"SELECT id AS a_id FROM a WHERE state = 'active' AND stance = 'support' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2025-06-01') AND (valid_until IS NULL OR TIMESTAMP '2025-06-01' < valid_until)"),
    "pat_traversal_1_3": ('FIND(?s, ?o) WHERE { PROPOSITION (?s, "depends_on"{1,3}, ?o) }', "WITH RECURSIVE w AS (SELECT s, o, 1 AS d FROM g WHERE pred = 'depends_on' UNION SELECT w.s, g.o, d + 1 FROM w JOIN g ON g.s = w.o AND pred = 'depends_on' WHERE d < 3) SELECT DISTINCT s, o FROM w WHERE s <> o"),
    "pat_traversal_unbounded": ('FIND(?o) WHERE { ?s CONCEPT {type: "Service"} PROPOSITION (?s, "depends_on"{1,}, ?o) }', "WITH RECURSIVE w AS (SELECT g.s, o FROM g JOIN c ON c.id = g.s AND type = 'Service' AND state = 'active' WHERE pred = 'depends_on' UNION SELECT w.s, g.o FROM w JOIN g ON g.s = w.o AND pred = 'depends_on') SELECT o FROM w WHERE s <> o"),
    "pat_traversal_reverse": ('FIND(?s) WHERE { PROPOSITION (?s, "depends_on"{1,2}, {id: "C-3"}) }', "WITH w AS (SELECT s FROM g WHERE pred = 'depends_on' AND o = 'C-3' UNION SELECT h.s FROM g JOIN g h ON h.o = g.s AND h.pred = 'depends_on' WHERE g.pred = 'depends_on' AND g.o = 'C-3') SELECT s FROM w WHERE s <> 'C-3'"),
    "bp_query": (f'FIND(?p.id, ?b.status, ?b.support.score) WHERE {{ ?p PROPOSITION (?s, ?k, ?o) ?b BELIEF (?p) FILTER(?b.support.score > 0.5) }} FOR TIME "{_AT}"', None),
}


def _language(text: str):
    return lambda spark, d: run(StoreView(spark, d), text)


def _round_scores(q):
    return lambda spark, d: q(spark, d).withColumn("b_support_score", F.round("b_support_score", 6))


def as_of_query(spark: SparkSession, d: str) -> DataFrame:
    return run(StoreView(spark, d), 'FIND(?c.id, ?c.name) WHERE { ?c CONCEPT {} } AS OF TIME "2025-12-15T00:00:00Z"')


def as_of_seq(spark: SparkSession, d: str) -> DataFrame:
    return history.as_of(table(spark, d, "element_versions"), 150).select("space", "element", "seq")


def as_of_time(spark: SparkSession, d: str) -> DataFrame:
    at = history.seqs_at(table(spark, d, "tx_journal"), F.lit("2025-12-15 00:00:00").cast("timestamp"))
    return history.as_of(table(spark, d, "element_versions"), at).select("space", "element", "seq")


def history_element(spark: SparkSession, d: str) -> DataFrame:
    return history.element_history(table(spark, d, "element_versions"), "C-1", 10, 300)


def history_space(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a space in a range of its commits, a page of 200 after the first 50."""
    return history.space_history(table(spark, d, "element_versions"), "main-desk", 5, 400, limit=200, offset=50)


def changes(spark: SparkSession, d: str) -> DataFrame:
    return history.changes(table(spark, d, "tx_journal"), "main-desk", 40).select("seq", "tx_id", "status")


def visible_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changed elements per commit, for a reader that may see active concepts outside the space lab-notes."""
    view = StoreView(spark, d, visible={"CONCEPT": (F.col("space") != "lab-notes") & (F.col("state") == "active")})
    seen = history.visible_changes(table(spark, d, "element_versions"), view.rows("CONCEPT").select(F.col("id").alias("element")))
    return seen.groupBy("space", "seq").agg(F.count("*").alias("elements"))


def transaction_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All commits that carry an idempotency key, by these keys."""
    j = table(spark, d, "tx_journal")
    return history.transactions(j, keys=j.select("idempotency_key"))


_CLAIM_AT = "2025-06-01"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return StoreView(spark, d).claims()


def bp_eligibility(spark: SparkSession, d: str) -> DataFrame:
    e = belief.eligibility(_claims(spark, d), at=F.lit(_CLAIM_AT).cast("timestamp"))
    return e.groupBy("excluded").agg(F.count("*").alias("claims"), F.round(F.sum("confidence"), 4).alias("confidence"))


def _beliefs(spark: SparkSession, d: str) -> DataFrame:
    return StoreView(spark, d).beliefs(belief.BASELINE, F.lit(_CLAIM_AT).cast("timestamp"))


def bp_score(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _beliefs(spark, d).select("id", r("support"), r("opposition"), "support_voices", "opposition_voices")


def bp_classify(spark: SparkSession, d: str) -> DataFrame:
    return _beliefs(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def bp_slot(spark: SparkSession, d: str) -> DataFrame:
    v = StoreView(spark, d)
    edges = v.edges().filter("pred = 'status'").select(F.col("p").alias("id"), F.col("s").alias("subject"), F.col("pred").alias("predicate"), F.col("o").alias("object"))
    return belief.slots(edges, _beliefs(spark, d)).withColumn("accepted_values", F.array_join("accepted_values", " "))


def bp_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return belief.uncertainty(_beliefs(spark, d)).withColumn("reasons", F.array_join("reasons", " "))


def bp_slot_query(spark: SparkSession, d: str) -> DataFrame:
    text = f'FIND(?c.id, ?b.leading, ?b.contested) WHERE {{ ?c CONCEPT {{type: "Service"}} ?b BELIEF SLOT (?c, "status") }} FOR TIME "{_AT}"'
    return run(StoreView(spark, d), text)


def row_visibility(spark: SparkSession, d: str) -> DataFrame:
    view = StoreView(spark, d, visible={"CONCEPT": F.col("space").isin("main-desk", "field-ops")}, max_results=500)
    return run(view, "FIND(?c.id, ?c.space_id) WHERE { ?c CONCEPT {} } ORDER BY ?c.id")


def field_mask(spark: SparkSession, d: str) -> DataFrame:
    """Names are shown, attributes are masked before the filter sees them: without the mask fewer concepts would come."""
    view = StoreView(spark, d, masked={"CONCEPT": {("attributes",)}})
    return run(view, 'FIND(?c.id, ?c.name, ?c.attributes.rank) WHERE { ?c CONCEPT {type: "Topic"} FILTER(IS_NULL(?c.attributes.rank)) }')


def counts(spark: SparkSession, d: str) -> DataFrame:
    return meta.counts(StoreView(spark, d))


def referrers(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each reference field point to an element."""
    view, out = StoreView(spark, d), None
    for name in ("merged_into", "proposition", "evidence", "supersedes", "generated_by", "inputs", "outputs"):
        part = view.links(name).groupBy("o").agg(F.count("*").alias("n")).select(F.col("o").alias("element"), F.lit(name).alias("field"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def merge_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every merged concept with the one that stands for it now; chains that never end resolve to themselves."""
    rows = live(table(spark, d, "concepts")).select(key_of("concepts").alias("node"), present(F.col("merged_into")).alias("parent")).dropna().distinct()
    found = hierarchy(rows)
    return found.select("node", F.when(F.col("root") == CYCLE, F.col("node")).otherwise(F.col("root")).alias("resolved"))


def capsule_closure(spark: SparkSession, d: str) -> DataFrame:
    """What an export of the archived topics takes along: references followed over at most 3 hops."""
    view, edges = StoreView(spark, d), None
    parts = [view.links(n) for n in ("proposition", "evidence", "generated_by", "inputs")]
    parts += [view.edges().select("s", F.col("p").alias("o")), view.edges().select(F.col("p").alias("s"), "o")]
    for p in parts:
        p = p.select(F.col("s").alias("src"), F.col("o").alias("dst"))
        edges = p if edges is None else edges.unionByName(p)
    roots = view.rows("CONCEPT").filter("state = 'archived'").select(F.col("id").alias("start"))
    return walk(edges.filter("dst not like 'lit%'"), roots, 0, 3).groupBy("start").agg(F.count("*").alias("elements"), F.max("depth").cast("long").alias("depth"))


def search_elements(spark: SparkSession, d: str) -> DataFrame:
    """Ranked active concepts of one type by their names: four times the limit is ranked, then filtered."""
    rows = StoreView(spark, d).rows("CONCEPT").withColumn("written", F.concat_ws("\n", "name", F.array_join("aliases", "\n")))
    found = bm25.bm25_search(rows, "marine services paper", key="id", text="written", k=80)
    kept = rows.filter("state = 'active'").filter(F.element_at(F.split("schema_ref", "/"), -1) == "Organization").select("id")
    return found.join(kept, "id", "left_semi").orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


def search_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The words in concepts, propositions and evidence of all spaces, merged by score."""
    found = meta.search(StoreView(spark, d), "marine services depends_on thermostat", limit=40)
    return found.select("id", "kind", F.round("score", 6).alias("score"))


def list_types(spark: SparkSession, d: str) -> DataFrame:
    return meta.list_(StoreView(spark, d), "TYPES").unionByName(meta.list_(StoreView(spark, d), "PREDICATES"))


def list_spaces(spark: SparkSession, d: str) -> DataFrame:
    return meta.list_(StoreView(spark, d), "SPACES")


def authorized(spark: SparkSession, d: str) -> DataFrame:
    """What a reader finds who is allowed two spaces and, anywhere, active topics, but nothing merged."""
    some = [
        Statement(True, frozenset({"reader"}), frozenset({"read"}), frozenset({"CONCEPT"}), frozenset({"main-desk", "field-ops"})),
        Statement(True, None, frozenset({"read"}), frozenset({"CONCEPT"}), where="state = 'active' and schema_ref like '%/Topic'"),
        Statement(False, where="coalesce(merged_into, '') <> ''"),
    ]
    may = authorize(some, "reader")
    view = StoreView(spark, d, visible={k: c for k, c in may.visible.items() if k == "CONCEPT"}, masked=may.masked, max_results=may.max_results)
    return run(view, 'FIND(?c.id, ?c.space_id) WHERE { ?c CONCEPT {state: ["active", "archived", "merged"]} }')


_PLAIN = (search_elements, search_kinds, list_types, list_spaces, authorized, as_of_query, as_of_seq, as_of_time, history_element, history_space, changes, visible_changes, transaction_lookup, bp_eligibility, bp_score, bp_classify, bp_slot, bp_slot_query, bp_uncertainty, row_visibility, field_mask, counts, referrers, merge_resolve, capsule_closure)


def queries() -> dict:
    out = {k: _language(q) for k, (q, _) in _LANGUAGE.items()}
    out["bp_query"] = _round_scores(out["bp_query"])
    return out | {f.__name__: f for f in _PLAIN}


_VIEWS = """c AS (SELECT DISTINCT ON (_id) 'C-' || _id AS id, split_part(schema_ref, '/', -1) AS type, * FROM concepts),
p AS (SELECT DISTINCT ON (_id) 'P-' || _id AS id, split_part(predicate_ref, '/', -1) AS pred, * FROM propositions),
a AS (SELECT DISTINCT ON (_id) 'A-' || _id AS id, * FROM assertions), e AS (SELECT DISTINCT ON (_id) 'E-' || _id AS id, * FROM evidence), x AS (SELECT DISTINCT ON (_id) 'X-' || _id AS id, * FROM activities),
g AS (SELECT id AS p, CASE WHEN subject_key LIKE 'id' || chr(31) || '%' THEN substr(subject_key, 4) ELSE subject_key END AS s, pred, CASE WHEN object_key LIKE 'id' || chr(31) || '%' THEN substr(object_key, 4) ELSE object_key END AS o FROM p WHERE state = 'active')"""


def _with(sql: str) -> str:
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {_VIEWS}, {sql[15:]}"
    if sql.startswith("WITH "):
        return f"WITH {_VIEWS}, {sql[5:]}"
    return f"WITH {_VIEWS} {sql}"


_ELIGIBLE = """k AS (SELECT id, proposition_id AS target, asserted_by_key AS actor, stance, CASE WHEN coalesce(confidence, -1) < 0 THEN 0.5 ELSE least(confidence, 1) END AS conf,
 list_distinct(list_filter(list_transform(coalesce(evidence_refs, []), lambda t: CASE WHEN t LIKE '{%' THEN coalesce(json_extract_string(t, '$.evidence_id'), json_extract_string(t, '$.id')) ELSE t END), lambda t: t IS NOT NULL)) AS ev,
 CASE WHEN coalesce(state, '') <> 'active' THEN 'not_visible' WHEN status IN ('retracted', 'superseded', 'expired') THEN status WHEN coalesce(status, '') <> 'active' THEN 'not_visible'
 WHEN valid_from > TIMESTAMP '2025-06-01' OR valid_until <= TIMESTAMP '2025-06-01' THEN 'outside_valid_time' WHEN mode = 'hypothetical' THEN 'hypothetical_not_requested' WHEN mode = 'predicted' THEN 'prediction_not_requested'
 WHEN coalesce(mode, '') NOT IN ('observed', 'stated', 'inferred', 'imported') THEN 'policy_excluded' END AS excluded FROM a)"""
_SCORES = f"""{_ELIGIBLE},
d AS (SELECT target, CASE stance WHEN 'support' THEN 's' ELSE 'o' END AS side, id, actor, ev, conf FROM k WHERE excluded IS NULL AND stance IN ('support', 'reject')),
sl AS (SELECT p AS target, s, o FROM g WHERE pred = 'status'),
sd AS (SELECT * FROM d UNION ALL SELECT r.target, 'o', d.id, d.actor, d.ev, d.conf FROM d JOIN sl m ON m.target = d.target JOIN sl r ON r.s = m.s AND r.o <> m.o WHERE d.side = 's'),
z AS (SELECT sd.* FROM sd JOIN g ON g.p = sd.target),
ky AS (SELECT target, side, id, 'a' || actor AS key FROM z WHERE length(actor) > 0 UNION SELECT target, side, id, 'e' || unnest(ev) FROM z),
re AS (SELECT target, side, id, id AS o FROM ky UNION SELECT r.target, r.side, r.id, k2.id FROM re r JOIN ky k1 ON k1.target = r.target AND k1.side = r.side AND k1.id = r.o JOIN ky k2 ON k2.target = k1.target AND k2.side = k1.side AND k2.key = k1.key),
gr AS (SELECT target, side, id, min(o) AS voice FROM re GROUP BY ALL),
vo AS (SELECT z.target, z.side, coalesce(gr.voice, z.id) AS voice, max(conf) AS conf FROM z LEFT JOIN gr USING (target, side, id) GROUP BY ALL),
sc AS (SELECT target, side, 1 - product(1 - conf) AS score, count(*) AS n FROM vo GROUP BY ALL),
b AS (SELECT g.p AS id, coalesce(max(score) FILTER (side = 's'), 0) AS support, coalesce(max(score) FILTER (side = 'o'), 0) AS opposition, coalesce(max(n) FILTER (side = 's'), 0) AS support_voices, coalesce(max(n) FILTER (side = 'o'), 0) AS opposition_voices FROM g LEFT JOIN sc ON sc.target = g.p GROUP BY g.p),
un AS (SELECT target, count(*) FILTER (excluded IS NULL AND stance = 'uncertain') AS u, count(*) FILTER (excluded IS NOT NULL) AS x FROM k GROUP BY target),
bs AS (SELECT b.*, coalesce(u, 0) AS uncertain_claims, coalesce(x, 0) AS excluded_claims, CASE WHEN support_voices = 0 AND opposition_voices = 0 AND coalesce(u, 0) = 0 THEN 'insufficient' WHEN support >= 0.7 AND opposition < 0.3 THEN 'accepted' WHEN opposition >= 0.7 AND support < 0.3 THEN 'rejected' WHEN support >= 0.3 AND opposition >= 0.3 THEN 'contested' ELSE 'uncertain' END AS status FROM b LEFT JOIN un ON un.target = b.id)"""
_SLOTS = """so AS (SELECT g.s AS subject, g.pred AS predicate, bs.*, CAST(split_part(bs.id, '-', 2) AS BIGINT) AS num FROM bs JOIN g ON g.p = bs.id WHERE g.pred = 'status'),
st AS (SELECT subject, predicate, coalesce(string_agg(id, ' ' ORDER BY num) FILTER (status = 'accepted'), '') AS accepted_values, count(*) FILTER (status = 'accepted') AS accepted,
 max(CASE WHEN status <> 'insufficient' THEN {'a': support, 'n': num, 'i': id} END).i AS lead_, count(*) FILTER (status = 'accepted') > 1 OR count(*) FILTER (status = 'contested') > 0 AS contested FROM so GROUP BY ALL)"""
_REFERENCES = """rw AS (SELECT id AS s, 'merged_into' AS field, merged_into AS t FROM c WHERE state IN ('active', 'merged') UNION ALL SELECT id, 'proposition', proposition_id FROM a WHERE state = 'active' UNION ALL SELECT id, 'evidence', unnest(evidence_refs) FROM a WHERE state = 'active'
 UNION ALL SELECT id, 'supersedes', unnest(supersedes) FROM a WHERE state = 'active' UNION ALL SELECT id, 'generated_by', generated_by FROM e WHERE state = 'active' UNION ALL SELECT id, 'inputs', unnest(inputs) FROM x WHERE state = 'active' UNION ALL SELECT id, 'outputs', unnest(output_keys) FROM x WHERE state = 'active'),
rf AS (SELECT DISTINCT s, field, o FROM (SELECT s, field, CASE WHEN t LIKE '{%' THEN CASE WHEN json_extract_string(t, '$.space') IS NULL THEN coalesce(json_extract_string(t, '$.evidence_id'), json_extract_string(t, '$.id')) END ELSE nullif(t, '') END AS o FROM rw) WHERE o IS NOT NULL)"""
_PAST = """l AS (SELECT v.space, element, v.seq, version, lower(trim(op)) AS op, "row" AS r FROM element_versions v {join}), m AS (SELECT space, element, max(seq) AS seq FROM l GROUP BY ALL), now_ AS (SELECT DISTINCT l.space, l.element, l.seq FROM l JOIN m USING (space, element, seq) WHERE op <> 'purge' AND r IS NOT NULL)"""


def _search_sql(words: list[str], top: int) -> str:
    """Ranked words in the texts of three kinds, the best of each merged."""
    parts, ctes = [], []
    for v, kind, text in (("c", "concept", "concat_ws(chr(10), name, array_to_string(aliases, chr(10)), attributes)"), ("p", "proposition", "coalesce(predicate_ref, '')"), ("e", "evidence", "coalesce(payload_inline, '')")):
        ctes.append(rf"""{v}1 AS (SELECT id, state, list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: octet_length(encode(x)) > 1) AS w FROM {v}), {v}2 AS (SELECT * FROM {v}1 WHERE len(w) > 0),
{v}3 AS (SELECT count(*) AS n, greatest(sum(len(w)) / count(*), 1) AS avgdl FROM {v}2), {v}4 AS (SELECT id, state, len(w) AS dl, q, len(list_filter(w, lambda x: x = q)) AS tf FROM (SELECT *, unnest({words!r}) AS q FROM {v}2)),
{v}5 AS (SELECT q, count(*) FILTER (tf > 0) AS df FROM {v}4 GROUP BY q),
{v}6 AS (SELECT id, state, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS score FROM {v}4 JOIN {v}5 USING (q), {v}3 GROUP BY ALL HAVING max(tf) > 0 ORDER BY score DESC, id LIMIT {4 * top})""")
        parts.append(f"SELECT id, '{kind}' AS kind, score FROM {v}6 WHERE state = 'active'")
    return f"WITH {_VIEWS}, {', '.join(ctes)} SELECT id, kind, round(score, 6) AS score FROM ({' UNION ALL '.join(parts)}) s ORDER BY s.score DESC, kind, id LIMIT {top}"


def oracle_sql() -> dict[str, str]:
    out = {k: _with(s) for k, (_, s) in _LANGUAGE.items() if s}
    past = _PAST.format(join="WHERE v.seq <= 150")
    when = _PAST.format(join="JOIN (SELECT space, coalesce(max(seq) FILTER (committed_at <= TIMESTAMP '2025-12-15'), 0) AS at_ FROM tx_journal WHERE seq IS NOT NULL GROUP BY space) t ON t.space = v.space AND v.seq <= t.at_")
    return out | {
        "as_of_seq": f"WITH {past} SELECT space, element, seq FROM now_",
        "as_of_time": f"WITH {when} SELECT space, element, seq FROM now_",
        "history_element": "SELECT element, seq, max(version) AS version, max(lower(trim(op))) AS op FROM element_versions WHERE element = 'C-1' AND seq BETWEEN 10 AND 300 GROUP BY ALL",
        "changes": "SELECT DISTINCT seq, tx_id, status FROM tx_journal WHERE space = 'main-desk' AND seq > 40 ORDER BY seq, tx_id LIMIT 100",
        "visible_changes": _with("SELECT space, seq, count(DISTINCT element) AS elements FROM element_versions WHERE element IN (SELECT id FROM c WHERE c.space <> 'lab-notes' AND c.state = 'active') GROUP BY ALL"),
        "transaction_lookup": "SELECT DISTINCT tx_id, space, seq, status, idempotency_key FROM tx_journal WHERE idempotency_key IS NOT NULL",
        "bp_eligibility": f"WITH {_VIEWS}, {_ELIGIBLE} SELECT excluded, count(*) AS claims, round(sum(conf), 4) AS confidence FROM k GROUP BY excluded",
        "bp_score": f"WITH RECURSIVE {_VIEWS}, {_SCORES} SELECT id, round(support, 6) AS support, round(opposition, 6) AS opposition, support_voices, opposition_voices FROM b",
        "bp_classify": f"WITH RECURSIVE {_VIEWS}, {_SCORES} SELECT status, count(*) AS n FROM bs GROUP BY status",
        "bp_slot": f"WITH RECURSIVE {_VIEWS}, {_SCORES}, {_SLOTS} SELECT subject, predicate, accepted_values, accepted, lead_ AS leading, contested FROM st",
        "bp_slot_query": f"WITH RECURSIVE {_VIEWS}, {_SCORES}, {_SLOTS} SELECT c.id AS c_id, lead_ AS b_leading, contested AS b_contested FROM st JOIN c ON c.id = st.subject WHERE c.type = 'Service' AND c.state = 'active'",
        "bp_uncertainty": f"""WITH RECURSIVE {_VIEWS}, {_SCORES} SELECT id, CASE WHEN status = 'insufficient' THEN 'total' WHEN status IN ('contested', 'uncertain') THEN 'high' WHEN opposition >= 0.3 THEN 'medium' ELSE 'low' END AS level,
 concat_ws(' ', CASE WHEN support_voices = 0 AND opposition_voices = 0 THEN 'no_eligible_claim' END, CASE WHEN support_voices > 0 AND opposition_voices > 0 THEN 'both_sides' END, CASE WHEN support_voices = 1 AND opposition_voices = 0 THEN 'single_voice' END, CASE WHEN uncertain_claims > 0 THEN 'uncertain_claims' END, CASE WHEN excluded_claims > 0 THEN 'excluded_claims' END) AS reasons FROM bs""",
        "history_space": "SELECT seq, element, version, op FROM (SELECT seq, element, max(version) AS version, max(lower(trim(op))) AS op FROM element_versions WHERE space = 'main-desk' AND seq BETWEEN 5 AND 400 GROUP BY ALL) ORDER BY seq, element LIMIT 200 OFFSET 50",
        "as_of_query": f"WITH {when} SELECT element AS c_id, name AS c_name FROM (SELECT DISTINCT element, json_extract_string(r, '$.name') AS name, json_extract_string(r, '$.state') AS state FROM l JOIN m USING (space, element, seq) WHERE op <> 'purge' AND r IS NOT NULL) WHERE element LIKE 'C-%' AND state = 'active'",
        "bp_query": f"WITH RECURSIVE {_VIEWS}, {_SCORES} SELECT id AS p_id, status AS b_status, round(support, 6) AS b_support_score FROM bs WHERE support > 0.5",
        "search_kinds": _search_sql(["marine", "services", "depends", "on", "thermostat"], 40),
        "list_types": _with("SELECT name, count(*) AS n FROM (SELECT split_part(schema_ref, '/', -1) AS name FROM c WHERE schema_ref IS NOT NULL) GROUP BY name UNION ALL SELECT name, count(*) FROM (SELECT split_part(predicate_ref, '/', -1) AS name FROM p WHERE predicate_ref IS NOT NULL) GROUP BY name"),
        "list_spaces": _with("SELECT space AS name, count(*) AS n FROM (SELECT space FROM c UNION ALL SELECT space FROM p UNION ALL SELECT space FROM a UNION ALL SELECT space FROM e UNION ALL SELECT space FROM x) WHERE space IS NOT NULL GROUP BY space"),
        "authorized": _with("SELECT id AS c_id, space AS c_space_id FROM c WHERE state IN ('active', 'archived', 'merged') AND (space IN ('main-desk', 'field-ops') OR state = 'active' AND type = 'Topic') AND coalesce(merged_into, '') = ''"),
        "search_elements": _with(
            r"""w AS (SELECT id, state, type, list_filter(regexp_split_to_array(lower(concat_ws(chr(10), name, array_to_string(aliases, chr(10)))), '[^\p{L}\p{N}]+'), lambda x: octet_length(encode(x)) > 1) AS w FROM c), k AS (SELECT * FROM w WHERE len(w) > 0),
s AS (SELECT count(*) AS n, greatest(sum(len(w)) / count(*), 1) AS avgdl FROM k), t AS (SELECT id, state, type, len(w) AS dl, q, len(list_filter(w, lambda x: x = q)) AS tf FROM (SELECT *, unnest(['marine', 'services', 'paper']) AS q FROM k)),
f AS (SELECT q, count(*) FILTER (tf > 0) AS df FROM t GROUP BY q), r AS (SELECT id, state, type, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS score FROM t JOIN f USING (q), s GROUP BY ALL HAVING max(tf) > 0 ORDER BY score DESC, id LIMIT 80)
SELECT id, round(score, 6) AS score FROM r WHERE state = 'active' AND type = 'Organization' ORDER BY r.score DESC, id LIMIT 20"""
        ).replace("WHERE state = 'active') w AS", "WHERE state = 'active'), w AS"),
        "capsule_closure": f"WITH RECURSIVE {_VIEWS}, {_REFERENCES}, ed AS (SELECT o AS dst, s AS src FROM rf WHERE field IN ('proposition', 'evidence', 'generated_by', 'inputs') UNION SELECT p, s FROM g UNION SELECT o, p FROM g), w AS (SELECT id AS start, id AS e, 0 AS d FROM c WHERE state = 'archived' UNION SELECT w.start, ed.dst, d + 1 FROM w JOIN ed ON ed.src = w.e WHERE d < 3 AND ed.dst NOT LIKE 'lit%'), m AS (SELECT start, e, min(d) AS d FROM w GROUP BY ALL) SELECT start, count(*) AS elements, max(d) AS depth FROM m GROUP BY start",
        "referrers": f"WITH {_VIEWS}, {_REFERENCES} SELECT o AS element, field, count(*) AS n FROM rf WHERE field <> 'superseded_by' GROUP BY ALL",
        "row_visibility": _with("SELECT id AS c_id, space AS c_space_id FROM c WHERE state = 'active' AND space IN ('main-desk', 'field-ops') ORDER BY id LIMIT 500"),
        "field_mask": _with("SELECT id AS c_id, name AS c_name, NULL AS c_attributes_rank FROM c WHERE state = 'active' AND type = 'Topic'"),
        "counts": _with("SELECT k AS kind, count(*) AS n FROM (SELECT 'concept' AS k, state FROM c UNION ALL SELECT 'proposition', state FROM p UNION ALL SELECT 'assertion', state FROM a UNION ALL SELECT 'evidence', state FROM e UNION ALL SELECT 'activity', state FROM x) WHERE state = 'active' GROUP BY k"),
        "merge_resolve": "WITH RECURSIVE l AS (SELECT DISTINCT 'C-' || _id AS node, merged_into AS parent FROM concepts WHERE coalesce(state, '') <> 'purged' AND length(merged_into) > 0), w AS (SELECT node, parent, [node, parent] AS seen, node = parent AS looped FROM l UNION ALL SELECT w.node, l.parent, list_append(seen, l.parent), list_contains(seen, l.parent) FROM w JOIN l ON l.node = w.parent WHERE NOT looped) SELECT node, CASE WHEN bool_or(looped) THEN node ELSE arg_max(parent, len(seen)) END AS resolved FROM w GROUP BY node",
    }
