"""Registered queries of the general data-maintenance operators (problems 1, 2, 3, 5, 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import merkle
from engram.operators.hierarchy import descendants, hierarchy
from engram.operators.intervals import merged_intervals
from engram.operators.orphans import OrphanState
from engram.runtime import materialize, scratch_path, table
from engram.sources.store import parent_links, records, references
from engram.streaming.change_apply import ChangeTable, current_rows, reduce_changes


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(parent_links(spark, d))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(parent_links(spark, d), with_path=True).withColumn("path", F.array_join("path", " > "))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(parent_links(spark, d), with_path=True, around=True))


def _periods(spark: SparkSession, d: str) -> DataFrame:
    return merged_intervals(table(spark, d, "assertions"), "proposition_id", "valid_from", "valid_until")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d).filter("kind = 'gap'").select(F.col("key").alias("proposition_id"), F.col("start_us").alias("gap_start_us"), F.col("end_us").alias("gap_end_us"))


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d).filter("kind = 'period'").select(F.col("key").alias("proposition_id"), "start_us", "end_us")


def _orphan_state(spark: SparkSession, d: str) -> OrphanState:
    """Two epochs: what was there at the middle of the store's time, then the rest and the deletions."""
    refs, recs = references(spark, d), records(spark, d)
    middle = table(spark, d, "activities").agg(F.expr("timestamp_micros(cast((unix_micros(cast(min(created_at) as timestamp)) + unix_micros(cast(max(created_at) as timestamp))) / 2 as bigint))")).first()[0]
    cut = F.lit(middle) if middle is not None else F.lit(None).cast("timestamp")
    early = F.coalesce(F.col("created_at").cast("timestamp") < cut, F.lit(False))
    event = recs.withColumn("at", F.lit(None).cast("long"))
    state = OrphanState(spark, scratch_path(spark, "orphans"))
    # a stub tells that its record was there and was deleted: the deletion comes in the second epoch
    state.advance(refs.filter(early), event.filter(early & F.col("alive")))
    state.advance(refs.filter(~early), event.filter(~(early & F.col("alive"))))
    return state


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphan_state(spark, d).orphans()


def p3_snapshots(spark: SparkSession, d: str) -> DataFrame:
    state = _orphan_state(spark, d)
    return state.snapshot(1).unionByName(state.snapshot(2))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("source_table", "source_field", "period").agg(F.count("*").alias("orphans"))


def _followed(spark: SparkSession, d: str) -> DataFrame:
    """The rows that exist after the feed was streamed through a table of keyed state, in about four batches of files."""
    feed, path = table(spark, d, "element_versions"), scratch_path(spark, "followed")
    state = ChangeTable(spark, f"{path}/state", "element", "seq", "op", "row")
    files = feed.inputFiles()
    # as a pattern the path may be one file as well as a folder of files
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", -(-len(files) // 4) or 1).parquet(f"{d}/element_versions.parque[t]")
    state.follow(stream.select("element", "seq", "op", "row"), f"{path}/checkpoint").awaitTermination()
    rows = state.current()
    return current_rows(reduce_changes(feed.limit(0), "element", "seq", "op", "row")) if rows is None else rows


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _followed(spark, d).select(F.col("key").alias("element"), "seq")


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    return _followed(spark, d).select(F.col("key").alias("element"), "seq", F.get_json_object("payload", "$.state").alias("state"), F.get_json_object("payload", "$.name").alias("name"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    feed, runs, journal = (table(spark, d, n) for n in ("element_versions", "sync_runs", "tx_journal"))
    sync = merkle.MerkleSync(spark, scratch_path(spark, "sync"))
    return merkle.pending_after(sync, materialize(merkle.first_arrivals(feed), "arrivals"), runs, journal).select("element", "seq")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p2_found, p2_periods, p3_found, p3_snapshots, p3_counts, p5_found, p5_rows, p6_found)}


_LINKS = """
live_c AS (SELECT 'C-' || _id AS k, nullif(merged_into, '') AS parent FROM concepts WHERE coalesce(state, '') <> 'purged'),
live_a AS (SELECT 'A-' || _id AS k, supersedes, superseded_by FROM assertions WHERE coalesce(state, '') <> 'purged'),
raw AS (SELECT k AS node, parent, 0 AS b FROM live_c WHERE parent IS NOT NULL
  UNION ALL SELECT k, unnest(superseded_by), 0 FROM live_a UNION ALL SELECT n, k, 1 FROM (SELECT unnest(supersedes) AS n, k FROM live_a) WHERE n IN (SELECT 'A-' || _id FROM assertions)),
links AS (SELECT node, arg_min(parent, b || parent) AS parent FROM raw
  WHERE length(node) > 0 AND (parent IN (SELECT k FROM live_c) OR parent IN (SELECT k FROM live_a)) GROUP BY node),
walk AS (SELECT node, parent AS up, [parent] AS path, parent = node AS looped FROM links
  UNION ALL SELECT w.node, l.parent, list_append(w.path, l.parent), list_contains(w.path, l.parent) OR l.parent = w.node FROM walk w JOIN links l ON l.node = w.up WHERE NOT w.looped),
ends AS (SELECT node, arg_max(up, len(path)) AS up, max(len(path)) AS depth, arg_max(path, len(path)) AS path, bool_or(looped) AS looped FROM walk GROUP BY node)
"""

_GAPS = """
WITH i AS (SELECT proposition_id AS k, coalesce(epoch_us(valid_from), -9223372036854775807) AS s, coalesce(epoch_us(valid_until), 9223372036854775807) AS e FROM assertions WHERE proposition_id IS NOT NULL),
r AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE s < e)
"""

_ORPHANS = """
WITH c AS (SELECT 'concepts' AS source_table, 'merged_into' AS source_field, _id AS source_id, merged_into AS target_id, created_at FROM concepts
  UNION ALL SELECT 'assertions', 'proposition_id', _id, proposition_id, created_at FROM assertions
  UNION ALL SELECT 'assertions', 'evidence_refs', _id, unnest(evidence_refs), created_at FROM assertions
  UNION ALL SELECT 'activities', 'inputs', _id, unnest(inputs), created_at FROM activities),
r AS (SELECT DISTINCT source_table, source_field, source_id, strftime(created_at, '%Y-%m') AS period,
  CASE WHEN target_id LIKE '{%' THEN CASE WHEN json_extract_string(target_id, '$.space') IS NULL THEN coalesce(json_extract_string(target_id, '$.evidence_id'), json_extract_string(target_id, '$.id')) END ELSE target_id END AS target_id FROM c),
there AS (SELECT 'C-' || _id AS k FROM concepts WHERE coalesce(state, '') <> 'purged' UNION SELECT 'P-' || _id FROM propositions WHERE coalesce(state, '') <> 'purged'
  UNION SELECT 'A-' || _id FROM assertions WHERE coalesce(state, '') <> 'purged' UNION SELECT 'E-' || _id FROM evidence WHERE coalesce(state, '') <> 'purged'
  UNION SELECT 'X-' || _id FROM activities WHERE coalesce(state, '') <> 'purged'),
o AS (SELECT source_table, source_field, source_id, target_id, period FROM r WHERE length(target_id) > 0 AND NOT EXISTS (SELECT 1 FROM there WHERE k = target_id))
"""

_SNAPSHOTS = f"""{_ORPHANS.split("there AS")[0].rstrip().rstrip(",")},
cut AS (SELECT (epoch_us(min(created_at)) + epoch_us(max(created_at))) // 2 AS at_ FROM activities),
k AS (SELECT 'C-' || _id AS k, state, created_at FROM concepts UNION ALL SELECT 'P-' || _id, state, created_at FROM propositions UNION ALL SELECT 'A-' || _id, state, created_at FROM assertions UNION ALL SELECT 'E-' || _id, state, created_at FROM evidence UNION ALL SELECT 'X-' || _id, state, created_at FROM activities),
lv AS (SELECT k, bool_or(epoch_us(created_at) < at_) AS early FROM k, cut WHERE coalesce(state, '') <> 'purged' GROUP BY k),
rr AS (SELECT source_table, source_field, source_id, period, early, CASE WHEN target_id LIKE '{{%' THEN CASE WHEN json_extract_string(target_id, '$.space') IS NULL THEN coalesce(json_extract_string(target_id, '$.evidence_id'), json_extract_string(target_id, '$.id')) END ELSE target_id END AS target_id
  FROM (SELECT *, strftime(created_at, '%Y-%m') AS period, coalesce(epoch_us(created_at) < at_, false) AS early FROM c, cut)),
e AS (SELECT 1 AS epoch, source_table, source_field, source_id, target_id, min(period) AS period FROM rr WHERE early AND length(target_id) > 0 GROUP BY ALL UNION ALL SELECT 2, source_table, source_field, source_id, target_id, min(period) FROM rr WHERE length(target_id) > 0 GROUP BY ALL)
SELECT source_table, source_field, period, count(*) FILTER (lv.k IS NULL OR epoch = 1 AND NOT coalesce(lv.early, false)) AS orphans, count(*) AS refs, epoch FROM e LEFT JOIN lv ON lv.k = e.target_id GROUP BY ALL
"""

_STATE = """
WITH f AS (SELECT element, seq, lower(trim(op)) AS op, "row" FROM element_versions),
s AS (SELECT element, max(seq) AS seq, max(seq) FILTER (op = 'create') AS born, max(seq) FILTER (op = 'purge') AS gone FROM f GROUP BY element),
cur AS (SELECT element, seq FROM s WHERE born IS NOT NULL AND (gone IS NULL OR gone < born))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH RECURSIVE {_LINKS} SELECT node, CASE WHEN looped THEN '(cycle)' ELSE up END AS root, CASE WHEN looped THEN -1 ELSE depth END AS depth FROM ends",
        "p1_paths": f"WITH RECURSIVE {_LINKS} SELECT node, CASE WHEN looped THEN '(cycle)' ELSE up END AS root, CASE WHEN looped THEN -1 ELSE depth END AS depth, CASE WHEN NOT looped THEN array_to_string(path, ' > ') END AS path FROM ends",
        "p1_descendants": f"WITH RECURSIVE {_LINKS} SELECT unnest(path[1:n]) AS ancestor, node AS descendant, unnest(range(1, n + 1)) AS distance FROM (SELECT *, depth - CASE WHEN looped THEN 1 ELSE 0 END AS n FROM ends)",
        "p2_found": f"{_GAPS} SELECT k AS proposition_id, reach AS gap_start_us, s AS gap_end_us FROM r WHERE s > reach",
        "p2_periods": f"{_GAPS}, n AS (SELECT k, s, e, sum(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r) "
        "SELECT k AS proposition_id, nullif(min(s), -9223372036854775807) AS start_us, nullif(max(e), 9223372036854775807) AS end_us FROM n GROUP BY k, g",
        "p3_found": f"{_ORPHANS} SELECT * FROM o",
        "p3_snapshots": _SNAPSHOTS,
        "p3_counts": f"{_ORPHANS} SELECT source_table, source_field, period, count(*) AS orphans FROM o GROUP BY ALL",
        "p5_found": f"{_STATE} SELECT * FROM cur",
        "p5_rows": f"""{_STATE} SELECT DISTINCT element, seq, json_extract_string(f."row", '$.state') AS state, json_extract_string(f."row", '$.name') AS name FROM cur JOIN f USING (element, seq)""",
        "p6_found": """
WITH j AS (SELECT DISTINCT tx_id, seq FROM tx_journal WHERE seq IS NOT NULL),
g AS (SELECT r.space, from_seq, coalesce(to_seq, j.seq) AS to_seq, read_until FROM sync_runs r LEFT JOIN j ON j.tx_id = r.last_tx_id WHERE r.status = 'succeeded'),
t AS (SELECT DISTINCT e.element, e.seq FROM element_versions e JOIN g ON g.space = e.space AND e.seq BETWEEN g.from_seq AND g.to_seq AND e.arrived_at <= g.read_until)
SELECT DISTINCT element, seq FROM element_versions ANTI JOIN t USING (element, seq)""",
    }
