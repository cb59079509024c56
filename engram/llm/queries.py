"""Registered queries of the operators on text (problems 4, 7, 8, 9) and their oracle SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import leakage, lookalikes, mixing, names
from engram.operators.pairs import blocked_join
from engram.runtime import materialize, table


def _written(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "concepts").withColumn("type", F.element_at(F.split("schema_ref", "/"), -1)).filter(F.col("type").isin("Person", "Organization"))
    every = F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return df.select(F.col("_id").alias("id"), "type", F.explode(every).alias("written"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    linked = materialize(names.link_names(_written(spark, d)).distinct(), "name_links")
    several = linked.join(linked.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1").select("entity"), "entity", "left_semi")
    pairs = blocked_join(several.select("entity", F.col("id").alias("concept_a")), several.select("entity", F.col("id").alias("concept_b")), ["entity"])
    return pairs.filter("concept_a < concept_b").select("concept_a", "concept_b")


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row a concept: its entity and in how many spellings and records that stands."""
    linked = materialize(names.link_names(_written(spark, d)).distinct(), "name_links")
    return linked.join(linked.groupBy("entity").agg(F.count("*").alias("records")), "entity").select(F.col("id").alias("concept"), "entity", "records")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked, and into how many documents."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("covered"), 4).alias("most_covered"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    sizes = materialize(mixing.sized(table(spark, d, "documents")), "sized")
    return mixing.mix(sizes, targets), targets


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed, _ = _mixed(spark, d)
    return mixed.select(F.col("key").alias("doc_id"), F.col("copy").cast("long").alias("copy"), "source", "tokens", F.round("finish", 6).alias("finish"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    mixed, targets = _mixed(spark, d)
    return mixing.shares(materialize(mixed, "mixed"), targets)


def _prints(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return materialize(lookalikes.fingerprints(docs, "doc_id", "text", lookalikes.rewriter_for(docs)), "prints")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalikes.lookalike_pairs(_prints(spark, d), "doc_id")
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", lookalikes.consistent(F.col("text"), lookalikes.rewriter_for(docs)).alias("text"))


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_entities, p7_found, p7_items, p8_mix, p8_shares, p9_found, p9_texts)}


def _form_sql(text: str) -> str:
    """A text in one form: joined forms spelled out, wide and look-alike letters as Latin ones, blanks as one, invisible characters gone, composed."""
    pairs = [(a, b) for source, target in lookalikes.LOOKALIKES.values() for a, b in zip(source, target)]
    pairs += [(chr(c + 0xFEE0), chr(c)) for c in range(0x21, 0x7F)] + [(c, " ") for c in "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"]
    for c in lookalikes._JOINED:
        text = f"replace({text}, '{c}', '{unicodedata.normalize('NFKC', c)}')"
    quoted = lambda chars: "'" + "".join(chars).replace("'", "''") + "'"
    text = f"translate({text}, {quoted(a for a, _ in pairs)}, {quoted(b for _, b in pairs)})"
    return rf"nfc_normalize(regexp_replace({text}, '[\x{{AD}}\x{{34F}}\x{{61C}}\x{{180B}}-\x{{180F}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{206F}}\x{{FE00}}-\x{{FE0F}}\x{{FEFF}}]', '', 'g'))"


def oracle_sql() -> dict[str, str]:
    form = _form_sql("text")
    return {
        "p9_found": f"WITH f AS (SELECT DISTINCT doc_id, text, {form} AS form FROM documents WHERE text IS NOT NULL) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
    }
