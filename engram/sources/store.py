"""The store's tables as inputs of the general operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.runtime import table

#: letter of an element key by table (fixed values of the data)
LETTERS = {"concepts": "C", "propositions": "P", "assertions": "A", "evidence": "E", "activities": "X"}


def key_of(name: str, id_column: str | Column = "_id") -> Column:
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.concat(F.lit(LETTERS[name] + "-"), c.cast("string"))


def id_of(name: str, key_column: str) -> Column:
    """The _id that a key of this table names, null if it is another's or no key."""
    id_ = F.substring(key_column, len(LETTERS[name]) + 2, 20).try_cast("bigint")
    return F.when(key_of(name, id_) == F.col(key_column), id_)


def present(c: Column) -> Column:
    """Null for what stands for unset: null or an empty string."""
    return F.when(F.length(c) > 0, c)


def live(df: DataFrame) -> DataFrame:
    """Without the stubs of purged records."""
    return df.filter(F.coalesce(F.col("state"), F.lit("")) != "purged")


def parent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent) of concepts (merged_into) and assertions (superseded), parents with a live row only.

    A child's own statement goes before the one of its successor where they differ. A
    key that only a successor names, without a row of its own, is no node.
    """
    concepts, assertions = table(spark, sf_dir, "concepts"), table(spark, sf_dir, "assertions")
    merged = live(concepts).select(key_of("concepts").alias("node"), present(F.col("merged_into")).alias("parent"), F.lit(0).alias("by"))
    own = live(assertions).select(key_of("assertions").alias("me"), "supersedes", "superseded_by")
    up = own.select(F.col("me").alias("node"), F.explode("superseded_by").alias("parent"), F.lit(0).alias("by"))
    down = own.select(F.explode("supersedes").alias("node"), F.col("me").alias("parent"), F.lit(1).alias("by"))
    down = down.join(assertions.select(key_of("assertions").alias("node")).distinct(), "node", "left_semi")
    links = merged.unionByName(up).unionByName(down).filter("length(node) > 0 and length(parent) > 0")
    there = live(concepts).select(key_of("concepts").alias("parent")).unionByName(own.select(F.col("me").alias("parent"))).distinct()
    links = links.join(there, "parent", "left_semi")
    return links.groupBy("node").agg(F.min(F.struct("by", "parent")).getField("parent").alias("parent"))


def _entry_key(c: Column) -> Column:
    """The key an entry of evidence_refs or inputs names; null for another store's."""
    parsed = F.from_json(c, "evidence_id string, id string, space string")
    key = F.coalesce(present(parsed.getField("evidence_id")), present(parsed.getField("id")))
    return F.when(c.startswith("{"), F.when(parsed.getField("space").isNull(), key)).otherwise(present(c))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of the four fields: source_table, source_field, source_id, target_id, period, created_at."""
    parts = []
    for name, field, many in (("assertions", "proposition_id", False), ("assertions", "evidence_refs", True), ("concepts", "merged_into", False), ("activities", "inputs", True)):
        df = table(spark, sf_dir, name).select("_id", "created_at", (F.explode(field) if many else F.col(field)).alias("entry"))
        target = _entry_key(F.trim("entry")) if many else present(F.col("entry"))
        parts.append(df.select(F.lit(name).alias("source_table"), F.lit(field).alias("source_field"), F.col("_id").alias("source_id"), target.alias("target_id"), F.date_format("created_at", "yyyy-MM").alias("period"), "created_at"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("target_id is not null")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as an event of its key: key, alive (false for a purged stub), at, created_at."""
    out = None
    for name in LETTERS:
        df = table(spark, sf_dir, name).select(key_of(name).alias("key"), (F.coalesce(F.col("state"), F.lit("")) != "purged").alias("alive"), "created_at")
        out = df if out is None else out.unionByName(df)
    return out
