"""Writing the graph: the clauses of the write language as set operations on versioned tables.

Each call reads the state before it, computes the new row versions of all selected
elements at once and appends them as one commit over all kinds; unchanged rows write
nothing. Inside ``transaction`` several calls make one commit or none.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.sources.collection import CollectionError, CommitLog, VersionedTable, commit_all, numbered
from engram.runtime import materialize, maybe_among
from engram.sources.store import LETTERS, id_of, key_of

COMMON = "space string, state string"
KINDS = {
    "concepts": f"{COMMON}, schema_ref string, key string, name string, canonical_id string, aliases array<string>, attributes string, facets string, structural map<string,array<string>>, merged_into string, retention string, purged_digest string",
    "propositions": f"{COMMON}, subject_key string, predicate_ref string, object_key string, tuple_key string, retention string, purged_digest string",
    "assertions": f"{COMMON}, proposition_id string, asserted_by_key string, stance string, mode string, confidence double, valid_from timestamp, valid_until timestamp, evidence_refs array<string>, status string, supersedes array<string>, superseded_by array<string>, retention string, purged_digest string",
    "evidence": f"{COMMON}, evidence_class string, payload_inline string, observed_at timestamp, generated_by string, status string, corrects array<string>, corrected_by array<string>, retention string, purged_digest string",
    "activities": f"{COMMON}, activity_class string, started_at timestamp, ended_at timestamp, inputs array<string>, output_keys array<string>, status string, retention string, purged_digest string",
}
REQUIRED = {"concepts": ("schema_ref",), "propositions": ("subject_key", "predicate_ref", "object_key"), "assertions": ("proposition_id", "stance", "mode"), "evidence": ("evidence_class",), "activities": ("activity_class",)}
TERMINAL = ("completed", "failed", "cancelled")


def tuple_key() -> Column:
    """Identity of a proposition: a digest of its length-prefixed parts."""
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in ("space", "subject_key", "predicate_ref", "object_key")]
    return F.sha2(F.concat(*parts), 256)


class GraphStore:
    """The five kinds of elements as versioned tables under one commit log."""

    def __init__(self, spark: SparkSession, path: str):
        from pyspark.sql.types import StructType

        self.spark, self.log = spark, CommitLog(spark, path)
        self.tables = {k: VersionedTable(spark, path, StructType.fromDDL(ddl), self.log, k) for k, ddl in KINDS.items()}
        self._pending: dict[str, DataFrame] | None = None

    def read(self, kind: str, upto: int | None = None) -> DataFrame:
        """The live rows; inside a transaction those of its own writes on top, unless a coordinate is given."""
        rows = self.tables[kind].current(upto)
        if self._pending and upto is None and kind in self._pending:
            own = self._pending[kind].drop("_deleted")
            rows = rows.join(own.select("_id"), "_id", "left_anti").unionByName(own.select(*rows.columns))
        return rows.withColumn("id", key_of(kind))

    def load(self, kind: str, rows: DataFrame) -> int | None:
        """Take over records with their ids, as version 1; of an id given again one record. The rows are read more than once, so they must be the same each time."""
        names = [f.name for f in self.tables[kind].schema if f.name not in ("_version", "_deleted")]
        own = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).alias(n) for n in names])
        again = maybe_among(own.groupBy("_id").count().filter("count > 1"))
        own = own.filter(~again).unionByName(own.filter(again).dropDuplicates(["_id"]))  # few rows are shuffled whole
        return self._append(kind, own.withColumn("_version", F.lit(1)))

    def _append(self, kind: str, rows: DataFrame) -> int | None:
        rows = rows if "_deleted" in rows.columns else rows.withColumn("_deleted", F.lit(False))
        if self._pending is None:
            return self.tables[kind].commit(rows)
        rows = materialize(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.tables[kind].schema]), "staged")
        if kind in self._pending:
            # an element has one new version a transaction, whatever the number of its clauses
            rows = self._pending[kind].join(rows.select("_id"), "_id", "left_anti").unionByName(rows)
        self._pending[kind] = rows
        return None

    @contextmanager
    def transaction(self, *, dry_run: bool = False):
        """Calls inside make one commit at the end, nothing if one of them fails or with ``dry_run``.

        Yields a dict that has ``seq`` (null if nothing differs) and ``written``, the
        elements written by kind, after the end. Another writer's commit since the
        beginning is a conflict.
        """
        if self._pending is not None:
            raise CollectionError("a transaction is open")
        begun, result = (self.log.commits() or [0])[-1], {"seq": None, "written": {}}
        self._pending = {}
        try:
            yield result
            rows = {}
            for kind, df in self._pending.items():
                was = self.tables[kind].current().select("_id", F.col("_version").alias("_was"))
                one = df.join(was, "_id", "left").withColumn("_version", F.coalesce(F.col("_was"), F.lit(0)) + 1).drop("_was")
                rows[self.tables[kind]] = one
                result["written"][kind] = df.count()
            if not dry_run:
                result["seq"] = commit_all(self.log, rows, begun)
        finally:
            self._pending = None

    # -- create -----------------------------------------------------------------------------

    def create(self, kind: str, rows: DataFrame) -> int | None:
        """New elements; required fields must be there, a confidence above 1 is refused, none is -1."""
        t = self.tables[kind]
        names = [f.name for f in t.schema if not f.name.startswith("_")]
        full = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).alias(n) for n in names])
        full = full.withColumn("state", F.coalesce("state", F.lit("active")))
        if "status" in names:
            full = full.withColumn("status", F.coalesce("status", F.lit("running" if kind == "activities" else "active")))
        if kind == "assertions":
            full = full.withColumn("confidence", F.coalesce("confidence", F.lit(-1.0)))
            if full.filter("confidence > 1").limit(1).count():
                raise CollectionError("a confidence is at most 1")
        if kind == "propositions":
            full = full.withColumn("tuple_key", tuple_key())
        missing = reduce(Column.__or__, [F.col(c).isNull() for c in REQUIRED[kind]])
        if full.filter(missing).limit(1).count():
            raise CollectionError(f"{kind} need {', '.join(REQUIRED[kind])}")
        top = self.top(kind)
        typed = full.select(*[F.col(f.name).cast(f.dataType) for f in t.schema if not f.name.startswith("_")])
        return self._append(kind, numbered(typed, top + 1).withColumn("_version", F.lit(1)))

    def top(self, kind: str) -> int:
        """The greatest id given so far, to purged and staged elements too."""
        ids = self.tables[kind].log().select("_id")
        if self._pending and kind in self._pending:
            ids = ids.unionByName(self._pending[kind].select("_id"))
        return ids.agg(F.coalesce(F.max("_id"), F.lit(0))).first()[0]

    def ensure_propositions(self, rows: DataFrame) -> int | None:
        """Create those whose tuple isn't there; repeated tuples count once."""
        keyed = rows.withColumn("tuple_key", tuple_key()).dropDuplicates(["tuple_key"])
        return self.create("propositions", keyed.join(self.read("propositions").select("tuple_key"), "tuple_key", "left_anti"))

    def upsert_concepts(self, rows: DataFrame) -> None:
        """Update by (space, type, key) the given non-null fields of concepts that are there, create the others."""
        key = ["space", "schema_ref", "key"]
        now, rows = self.read("concepts"), rows.dropDuplicates(key)
        fields = [c for c in rows.columns if c not in key]
        met = now.join(rows.select(*key, *[F.col(c).alias("_new_" + c) for c in fields]), key)
        fresh = rows.join(now.select(*key), key, "left_anti")
        self._write("concepts", met, {c: F.coalesce("_new_" + c, c) for c in fields})
        self.create("concepts", fresh)

    # -- change -----------------------------------------------------------------------------

    def _write(self, kind: str, hit: DataFrame, sets: dict[str, Column]) -> int | None:
        columns = [f.name for f in self.tables[kind].schema if f.name not in ("_deleted", "_version")]
        plain = lambda c, name: F.to_json(c) if name == "structural" else c  # noqa: E731 (maps can't be compared)
        differs = reduce(Column.__or__, [~plain(F.col(c), c).eqNullSafe(plain(e, c)) for c, e in sets.items()])
        return self._append(kind, hit.filter(differs).select(*[(sets[c] if c in sets else F.col(c)).alias(c) for c in columns], (F.col("_version") + 1).alias("_version")))

    def update(self, kind: str, where: Column, sets: dict[str, Column], *, expect_version: int | None = None, limit: int | None = None) -> int | None:
        """All expressions read the state before; of more than ``limit`` elements the first by id are taken."""
        fixed = {"key", "schema_ref", "tuple_key", "subject_key", "object_key", "predicate_ref", "_id", "space"} & set(sets)
        if fixed or not sets:
            raise CollectionError(f"can't be set: {sorted(fixed)}" if fixed else "nothing to set")
        hit = self.read(kind).filter(where)
        if expect_version is not None and hit.filter(F.col("_version") != expect_version).limit(1).count():
            raise CollectionError("VersionConflict")
        return self._write(kind, hit if limit is None else hit.orderBy("_id").limit(limit), sets)

    def archive(self, kind: str, where: Column) -> int | None:
        return self.update(kind, where & (F.col("state") == "active"), {"state": F.lit("archived")})

    def tombstone(self, kind: str, where: Column) -> int | None:
        return self.update(kind, where & (F.col("state") != "tombstoned"), {"state": F.lit("tombstoned")})

    def set_retention(self, kind: str, where: Column, retention: str) -> int | None:
        return self.update(kind, where, {"retention": F.lit(retention)})

    def retract(self, where: Column) -> int | None:
        return self.update("assertions", where & (F.col("status") == "active"), {"status": F.lit("retracted")})

    def supersede(self, pairs: DataFrame) -> int | None:
        """Rows old, new (keys of assertions): both sides are linked, the old one is superseded."""
        return self._linked("assertions", pairs, "superseded_by", "supersedes", "superseded")

    def correct_evidence(self, pairs: DataFrame) -> int | None:
        return self._linked("evidence", pairs, "corrected_by", "corrects", "corrected")

    def _linked(self, kind: str, pairs: DataFrame, forward: str, back: str, status: str) -> int | None:
        pairs = materialize(pairs.select("old", "new").dropna().distinct(), "pairs")
        if not pairs.filter("old = new").isEmpty():
            raise CollectionError("an element can't replace itself")
        named = pairs.select(F.col("old").alias("key"), F.col("new").alias("_f"), F.lit(None).cast("string").alias("_b")).unionByName(pairs.select(F.col("new").alias("key"), F.lit(None).cast("string").alias("_f"), F.col("old").alias("_b")))
        touched = named.withColumn("_id", id_of(kind, "key")).filter("_id is not null").groupBy("_id").agg(F.collect_set("_f").alias("_f"), F.collect_set("_b").alias("_b"))
        hit = self.read(kind).filter(maybe_among(touched)).join(touched, "_id")  # by _id, as the rows are shuffled by it already
        none = F.array().cast("array<string>")
        join = lambda c, extra: F.when(F.size(extra) > 0, F.array_sort(F.array_union(F.coalesce(c, none), extra))).otherwise(F.col(c))
        return self._write(kind, hit, {forward: join(forward, "_f"), back: join(back, "_b"), "status": F.when(F.size("_f") > 0, status).otherwise(F.col("status"))})

    def transition_activity(self, where: Column, status: str, ended_at: Column, outputs: list[str] | None = None) -> int | None:
        """Terminal activities don't change any more; outputs and end are frozen with the transition."""
        hit = self.read("activities").filter(where)
        if hit.filter(F.col("status").isin(*TERMINAL)).limit(1).count():
            raise CollectionError("a terminal activity is immutable")
        sets = {"status": F.lit(status)}
        if status in TERMINAL:
            sets["ended_at"] = F.coalesce("ended_at", ended_at)
        if outputs is not None:
            sets["output_keys"] = F.array(*map(F.lit, outputs)).cast("array<string>")
        return self._write("activities", hit, sets)

    def merge_concepts(self, pairs: DataFrame) -> int | None:
        """Rows source, target (keys): the source points to the target; merging again into the same is nothing, elsewhere an error, as is a cycle."""
        from engram.operators.hierarchy import CYCLE, hierarchy

        pairs = pairs.select("source", "target").dropna().distinct()
        now = self.read("concepts")
        met = pairs.join(now.select(F.col("id").alias("source"), F.col("merged_into").alias("old")), "source")
        if met.filter("source = target or (old is not null and old <> '' and old <> target)").limit(1).count():
            raise CollectionError("MergeConflict")
        links = now.filter("merged_into is not null").select(F.col("id").alias("node"), F.col("merged_into").alias("parent")).unionByName(pairs.select(F.col("source").alias("node"), F.col("target").alias("parent")))
        if not hierarchy(links).filter(F.col("root") == CYCLE).join(pairs.select(F.col("source").alias("node")), "node", "left_semi").isEmpty():
            raise CollectionError("the merge would make a cycle")
        hit = now.join(pairs.select(F.col("source").alias("id"), F.col("target").alias("_t")), "id")
        return self._write("concepts", hit, {"merged_into": F.col("_t"), "state": F.lit("merged")})

    # -- purge ------------------------------------------------------------------------------

    def references(self) -> DataFrame:
        """(src, dst) of every reference between live elements."""
        out = None
        for kind, columns in {"propositions": ["subject_key", "object_key"], "assertions": ["proposition_id", "asserted_by_key", "evidence_refs", "supersedes", "superseded_by"], "concepts": ["merged_into"], "evidence": ["generated_by", "corrects"], "activities": ["inputs", "output_keys"]}.items():
            df = self.read(kind)
            for c in columns:
                many = dict(df.dtypes)[c].startswith("array")
                part = df.select(F.col("id").alias("src"), (F.explode(c) if many else F.col(c)).alias("dst"))
                out = part if out is None else out.unionByName(part)
        key = F.regexp_extract("dst", r"([CPAEX]-\d+)", 1)  # an entry may be a key or a JSON object with one
        return out.select("src", key.alias("dst")).filter("dst <> '' and src <> dst").distinct()

    def purge(self, kind: str, where: Column, mode: str = "deny_if_referenced") -> int | None:
        """Erase the selected elements and all their versions; a stub keeps identity, space and a digest of what was there.

        ``deny_if_referenced`` refuses if others point to them, ``tombstone_reference``
        lets the pointers stand, ``authorized_cascade`` erases what points to them
        directly as well. A legal hold on any of these refuses the whole purge before
        anything is written. The stubs are one commit over all kinds; then the older
        versions are destroyed, which may be done again if it was broken off.
        """
        if mode not in ("deny_if_referenced", "tombstone_reference", "authorized_cascade"):
            raise CollectionError(f"no reference policy {mode}")
        if self._pending is not None:
            raise CollectionError("a purge is a transaction of its own")
        doomed = materialize(self.read(kind).filter(where).filter("state <> 'purged'").select("id").distinct(), "doomed")
        pointing = self.references().join(doomed.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(doomed, "id", "left_anti")
        if mode == "deny_if_referenced" and not pointing.isEmpty():
            raise CollectionError(f"PurgeDenied: {pointing.count()} elements still point to these")
        if mode == "authorized_cascade":
            doomed = materialize(doomed.unionByName(pointing).distinct(), "doomed")
        hit = {k: materialize(self.read(k).join(doomed, "id", "left_semi"), "hit") for k in KINDS}
        if any(not df.filter("retention = 'legal_hold'").isEmpty() for df in hit.values()):
            raise CollectionError("LegalHoldConflict: a legal hold blocks the purge")
        stubs, keep = {}, ("_id", "space")
        for k, df in hit.items():
            names = [f.name for f in self.tables[k].schema if f.name not in ("_version", "_deleted")]
            digest = F.sha2(F.to_json(F.struct(*names)), 256)
            value = lambda n: F.col(n) if n in keep else F.lit("purged") if n == "state" else digest if n == "purged_digest" else F.concat(F.lit("purged:"), F.col("_id")) if n == "tuple_key" else F.lit(None)
            stubs[self.tables[k]] = df.select(*[value(n).alias(n) for n in names], (F.col("_version") + 1).alias("_version"), F.lit(False).alias("_deleted"))
        seq = commit_all(self.log, stubs)
        for k, df in hit.items() if seq else ():
            if not df.isEmpty():
                self.tables[k].erase(df.select("_id"), seq - 1)
        return seq


__all__ = ["GraphStore", "KINDS", "LETTERS", "tuple_key"]
