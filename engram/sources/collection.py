"""Schema'd collections as append-only versioned tables.

A commit writes its rows to new folders of its own and then claims the next number by
a manifest that names them; readers see the commits whose manifest is there, and of
each id the row of the greatest version. A commit that dies half way, or that loses
its number to another writer, is invisible, and one over several tables is all or nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BATCH = 10_000


class CollectionError(ValueError):
    pass


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str
    optional: bool = True
    unique: bool = False
    idx: int = 0
    description: str = ""


@dataclass(frozen=True)
class CollectionSchema:
    """Declared fields of a version; ``composite`` lists field groups that are unique together."""

    fields: tuple[FieldDef, ...]
    version: int = 1
    composite: tuple[tuple[str, ...], ...] = ()

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T.StructType.fromDDL(f"x {f.type}")[0].dataType, True, {"idx": f.idx, "unique": f.unique, "description": f.description}) for f in self.fields])

    def conform(self, df: DataFrame) -> DataFrame:
        """The declared columns in order; missing ones are null, others are refused."""
        unknown = set(df.columns) - {f.name for f in self.fields} - {"_id"}
        if unknown:
            raise CollectionError(f"undeclared fields: {sorted(unknown)}")
        return df.select(*(["_id"] if "_id" in df.columns else []), *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.type).alias(f.name) for f in self.fields])

    def violations(self, df: DataFrame) -> DataFrame:
        """Rows that break a rule, with ``reason``: a missing required field, or a number that is none."""
        rules: list[tuple[Column, str]] = [(F.col(f.name).isNull(), f"{f.name} is required") for f in self.fields if not f.optional]
        rules += [(F.isnan(f.name), f"{f.name} is not a number") for f in self.fields if f.type in ("double", "float")]
        if not rules:
            return df.limit(0).withColumn("reason", F.lit(""))
        reason = reduce(lambda w, r: w.when(r[0], r[1]), rules[1:], F.when(*rules[0]))
        return df.withColumn("reason", reason).filter("reason is not null")


def evolve(old: CollectionSchema, new: CollectionSchema) -> CollectionSchema:
    """Check an upgrade: the version grows, kept fields keep number, type and uniqueness, new ones are optional, numbers aren't reused."""
    if new.version <= old.version:
        raise CollectionError("the version must grow")
    was, used = {f.name: f for f in old.fields}, {f.idx for f in old.fields}
    for f in new.fields:
        if f.name in was:
            o = was[f.name]
            if (o.idx, o.type, o.unique) != (f.idx, f.type, f.unique) or o.optional and not f.optional:
                raise CollectionError(f"{f.name} can't change like that")
        elif not f.optional or f.idx in used:
            raise CollectionError(f"{f.name} must be optional and have a new number")
    return new


class CommitLog:
    """Numbered commits below a folder: each names the data folders of the tables it wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: dict[int, dict[str, str]] = {}

    def fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def commits(self) -> list[int]:
        fs, p = self.fs("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def entries(self, seq: int) -> dict[str, str]:
        """Table -> folder, of a commit."""
        if seq not in self._known:
            fs, p = self.fs(f"manifest/{seq}")
            stream = fs.open(p)
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            self._known[seq] = dict(x.split("=", 1) for x in text.splitlines())
        return self._known[seq]

    def _put(self, name: str, entries: dict[str, str], overwrite: bool) -> None:
        fs, p = self.fs(name)
        stream = fs.create(p, overwrite)
        stream.writeBytes("".join(f"{t}={f}\n" for t, f in entries.items()))
        stream.close()

    def claim(self, seq: int, entries: dict[str, str]) -> None:
        """Publish a commit under a number that nobody has; a number taken meanwhile is a conflict."""
        fs, p = self.fs(f"manifest/{seq}")
        try:
            self._put(f"manifest/{seq}", entries, False)
        except Exception as e:
            if fs.exists(p):
                raise CollectionError(f"CommitConflict: commit {seq} was made by another writer") from e
            raise

    def redirect(self, seq: int, entries: dict[str, str]) -> None:
        """Let a commit name other folders."""
        self._put(f"manifest/.{seq}", entries, True)
        fs, draft = self.fs(f"manifest/.{seq}")
        _, p = self.fs(f"manifest/{seq}")
        fs.delete(p, False)
        fs.rename(draft, p)
        self._known.pop(seq, None)

    def drop(self, name: str) -> None:
        fs, p = self.fs(name)
        fs.delete(p, True)


class VersionedTable:
    """Rows with _id, _version and _deleted, written by the commits of a log that may cover further tables."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, log: CommitLog | None = None, name: str = "data"):
        self.spark, self.name, self.commits_ = spark, name, log or CommitLog(spark, path)
        self.schema = T.StructType([T.StructField("_id", T.LongType()), *[f for f in schema if f.name != "_id"], T.StructField("_version", T.LongType()), T.StructField("_deleted", T.BooleanType())])

    def commits(self) -> list[int]:
        return self.commits_.commits()

    def log(self, upto: int | None = None) -> DataFrame:
        """All row versions of the commits up to one, with ``_seq``: one scan, whatever the number of commits."""
        folders = [f for c in self.commits() if upto is None or c <= upto for f in [self.commits_.entries(c).get(self.name)] if f]
        if not folders:
            return self.spark.createDataFrame([], self.schema).withColumn("_seq", F.lit(0).cast("long"))
        seq = F.regexp_extract("_metadata.file_path", rf"/{self.name}/(\d+)-", 1).cast("long")
        return self.spark.read.schema(self.schema).parquet(*[f"{self.commits_.path}/{f}" for f in folders]).select(*[f.name for f in self.schema], seq.alias("_seq"))

    def current(self, upto: int | None = None) -> DataFrame:
        """The live rows: of each id the greatest version, without deleted ones."""
        # a window, as readers of a few columns then shuffle only those; a struct of all would keep them all
        newest = Window.partitionBy("_id").orderBy(F.desc("_seq"), F.desc("_version"))
        return self.log(upto).withColumn("_place", F.row_number().over(newest)).filter("_place = 1 and not _deleted").drop("_deleted", "_seq", "_place")

    def stage(self, rows: DataFrame, seq: int) -> str | None:
        """Write rows for a commit; the folder, or null if there are none."""
        folder = f"{self.name}/{seq}-{uuid.uuid4().hex[:12]}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(f"{self.commits_.path}/{folder}")
        if self.spark.read.schema(self.schema).parquet(f"{self.commits_.path}/{folder}").isEmpty():
            self.commits_.drop(folder)
            return None
        return folder

    def commit(self, rows: DataFrame) -> int | None:
        """Append row versions; nothing to append is no commit."""
        return commit_all(self.commits_, {self: rows})

    def erase(self, ids: DataFrame, upto: int) -> int:
        """Destroy all versions of the ids (_id) in the commits up to one; returns how many there were.

        Folders that hold any are written anew and named in the place of the old, which are deleted.
        """
        gone = 0
        for c in self.commits():
            folder = self.commits_.entries(c).get(self.name) if c <= upto else None
            if not folder:
                continue
            rows = self.spark.read.schema(self.schema).parquet(f"{self.commits_.path}/{folder}")
            n = rows.join(ids, "_id", "left_semi").count()
            if n:
                kept = self.stage(rows.join(ids, "_id", "left_anti"), c)
                entries = {t: f for t, f in self.commits_.entries(c).items() if t != self.name} | ({self.name: kept} if kept else {})
                self.commits_.redirect(c, entries)
                self.commits_.drop(folder)
                gone += n
        return gone

    def compact(self) -> int | None:
        """Write the live rows as one commit and forget the others."""
        old, live = self.commits(), self.current().withColumn("_deleted", F.lit(False))
        seq = self.commit(live)
        for c in old if seq else []:
            folder = self.commits_.entries(c).get(self.name)
            self.commits_.drop(f"manifest/{c}")
            if folder:
                self.commits_.drop(folder)
        return seq


def commit_all(log: CommitLog, rows: dict[VersionedTable, DataFrame], expected: int | None = None) -> int | None:
    """One commit over several tables of a log: all of it or nothing. Null if there is nothing to write.

    :param expected: the last commit that the rows were made from; another since then is a conflict.
    """
    last = (log.commits() or [0])[-1]
    if expected is not None and last != expected:
        raise CollectionError(f"CommitConflict: made from commit {expected}, the last is {last}")
    entries = {t.name: f for t, df in rows.items() if (f := t.stage(df, last + 1))}
    if not entries:
        return None
    log.claim(last + 1, entries)
    return last + 1


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """Add ``_id``: consecutive numbers from ``first`` on, in any order of the rows.

    Rows are written once with their place in their partition, the partitions' sizes
    give where each begins; nothing is shuffled and nothing runs in Python.
    """
    from engram.runtime import materialize

    place = F.monotonically_increasing_id()
    kept = materialize(rows.withColumn("_place", place), "numbered")
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.part, r.n) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    starts, total = [], first
    for p, n in sizes:
        starts.append((p, total))
        total += n
    begin = rows.sparkSession.createDataFrame(starts, "_part long, _begin long")
    return kept.withColumn("_part", part.cast("long")).join(F.broadcast(begin), "_part").withColumn("_id", F.col("_begin") + at).select("_id", *rows.columns)


class Collection:
    """Documents with generated ids, validation and unique fields."""

    def __init__(self, spark: SparkSession, path: str, schema: CollectionSchema):
        self.spark, self.schema, self.rows = spark, schema, VersionedTable(spark, path, schema.struct())

    def read(self) -> DataFrame:
        return self.rows.current()

    def _check(self, rows: DataFrame, others: DataFrame) -> None:
        bad = self.schema.violations(rows).first()
        if bad:
            raise CollectionError(bad.reason)
        for group in [(f.name,) for f in self.schema.fields if f.unique] + list(self.schema.composite):
            keys = rows.select(*group).unionByName(others.select(*group)).dropna()
            if keys.groupBy(*group).count().filter("count > 1").limit(1).count():
                raise CollectionError(f"{'-'.join(group)} must be unique")

    def insert(self, docs: DataFrame) -> int | None:
        """Validate and append; ids go on from the greatest given so far, in any order of the rows."""
        rows = self.schema.conform(docs.drop("_id"))
        self._check(rows, self.read())
        top = self.rows.log().agg(F.coalesce(F.max("_id"), F.lit(0))).first()[0]
        return self.rows.commit(numbered(rows, top + 1).withColumn("_version", F.lit(1).cast("long")).withColumn("_deleted", F.lit(False)))

    def insert_many(self, docs: DataFrame) -> int | None:
        """As ``insert``, of at most MAX_BATCH documents as a request may bring; bulk loads use ``insert``."""
        if docs.limit(MAX_BATCH + 1).count() > MAX_BATCH:
            raise CollectionError(f"at most {MAX_BATCH} documents at once")
        return self.insert(docs)

    def update(self, where: Column, changes: dict[str, Column], expect_version: int | None = None) -> int | None:
        """New versions of the matching documents whose values differ; no field is an error."""
        if not changes:
            raise CollectionError("nothing to update")
        unknown = set(changes) - {f.name for f in self.schema.fields}
        if unknown:
            raise CollectionError(f"undeclared fields: {sorted(unknown)}")
        now = self.read()
        hit = now.filter(where)
        if expect_version is not None and hit.filter(F.col("_version") != expect_version).limit(1).count():
            raise CollectionError("VersionConflict")
        types = {f.name: f.type for f in self.schema.fields}
        new = hit.select(*[(changes[c].cast(types[c]) if c in changes else F.col(c)).alias(c) for c in now.columns if c != "_version"], F.col("_version").alias("_old"), *[F.col(c).alias("_was_" + c) for c in changes])
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col("_was_" + c)) for c in changes])
        new = new.filter(~same)
        names = [f.name for f in self.schema.fields]
        self._check(new.select(*names), now.join(new.select("_id"), "_id", "left_anti").select(*names))
        return self.rows.commit(new.withColumn("_version", F.col("_old") + 1).withColumn("_deleted", F.lit(False)))

    def remove(self, where: Column) -> DataFrame:
        """Delete the matching documents; they are returned as they were."""
        from engram.runtime import materialize

        old = materialize(self.read().filter(where), "removed")
        self.rows.commit(old.withColumn("_version", F.col("_version") + 1).withColumn("_deleted", F.lit(True)))
        return old.drop("_version")

    def exists(self, id_: int) -> bool:
        return not self.read().filter(F.col("_id") == id_).isEmpty()

    def get(self, id_: int):
        row = self.read().filter(F.col("_id") == id_).first()
        if row is None:
            raise CollectionError(f"no document {id_}")
        return row

    def get_many(self, ids: Sequence[int]) -> DataFrame:
        from engram.operators.paging import get_many

        return get_many(self.read(), ids)

    def count(self) -> int:
        return self.read().count()
