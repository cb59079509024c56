"""Parts of a graph as capsules: exported with what they refer to, verified by a digest, imported under new ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.traverse import walk
from engram.runtime import materialize
from engram.sources.collection import CollectionError, numbered
from engram.sources.graph_store import KINDS, GraphStore, tuple_key
from engram.sources.store import key_of

#: references of a kind: column -> is it a list
REFERENCES = {
    "propositions": {"subject_key": False, "object_key": False},
    "assertions": {"proposition_id": False, "asserted_by_key": False, "evidence_refs": True, "supersedes": True, "superseded_by": True},
    "concepts": {"merged_into": False},
    "evidence": {"generated_by": False, "corrects": True, "corrected_by": True},
    "activities": {"inputs": True, "output_keys": True},
}
_KEY = r"([CPAEX]-\d+)"


def _digest(rows: DataFrame) -> str:
    """A digest of the set of rows: sums of pieces of each row's hash, so it can be made in parallel."""
    piece = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)"))
    hashed = rows.select(F.sha2(F.concat_ws("\x1f", "id", "kind", "row"), 256).alias("h"))
    sums = hashed.agg(F.count("*"), *[piece(1 + 15 * i) for i in range(4)]).first()
    return ":".join(str(x or 0) for x in sums)


def export(store: GraphStore, roots: DataFrame, *, depth: int = 3, spaces: list[str] | None = None) -> tuple[DataFrame, str]:
    """((id, kind, row as JSON), digest) of the roots (``id``) and what they refer to within some hops.

    Propositions lead to their ends, claims to their proposition, actor and evidence,
    and so on. Purged elements and other spaces stay out. No root is an error.
    """
    roots = roots.select(F.col("id").alias("start")).dropna().distinct()
    if roots.isEmpty():
        raise CollectionError("a capsule needs a root")
    edges = []
    for kind, columns in REFERENCES.items():
        df = store.read(kind).filter("state <> 'purged'")
        for c, many in columns.items():
            edges.append(df.select(F.col("id").alias("src"), (F.explode(c) if many else F.col(c)).alias("dst")))
    links = reduce(DataFrame.unionByName, edges).select("src", F.regexp_extract("dst", _KEY, 1).alias("dst")).filter("dst <> ''")
    taken = walk(links, roots, 0, depth).select(F.col("end").alias("id")).distinct()
    parts = []
    for kind in KINDS:
        names = [n for n in store.tables[kind].schema.names if n not in ("_version", "_deleted")]
        df = store.read(kind).filter("state <> 'purged'").join(taken, "id", "left_semi")
        df = df if spaces is None else df.filter(F.col("space").isin(spaces))
        parts.append(df.select("id", F.lit(kind).alias("kind"), F.to_json(F.struct(*names)).alias("row")))
    out = materialize(reduce(DataFrame.unionByName, parts), "capsule")
    return out, _digest(out)


def verify(capsule: DataFrame, digest: str) -> bool:
    """Whether the rows are those that the digest was made of."""
    return _digest(capsule.select("id", "kind", "row")) == digest


def _mapped(c: Column, many: bool, ids: str) -> Column:
    """A reference with its id, bare or inside a text, replaced by the new one; ids not taken along stay."""
    one = lambda x: F.coalesce(F.regexp_replace(x, _KEY, F.coalesce(F.element_at(F.col(ids), F.regexp_extract(x, _KEY, 1)), F.regexp_extract(x, _KEY, 1))), x)
    return F.transform(c, one) if many else one(c)


def import_(store: GraphStore, capsule: DataFrame, digest: str, *, space: str, isolate: bool = False) -> DataFrame:
    """Take over a capsule in one commit; returns (old, new) ids.

    Concepts with a canonical id that the space has are that concept, propositions with
    a tuple it has are that proposition; all others become new elements. References
    are rewritten. ``isolate`` marks what is new as quarantined. A digest that doesn't
    fit is refused.
    """
    capsule = materialize(capsule.select("id", "kind", "row"), "import")
    if not verify(capsule, digest):
        raise CollectionError("DigestMismatch: the capsule was changed")
    state = lambda c: F.when(c == "active", F.lit("quarantined")).otherwise(c) if isolate else c
    fields = {k: [f for f in store.tables[k].schema if f.name not in ("_version", "_deleted")] for k in KINDS}
    rows = {k: capsule.filter(F.col("kind") == k).select(F.col("id").alias("_old"), F.from_json("row", "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields[k]) + ">").alias("r")).select("_old", "r.*") for k in KINDS}

    def fresh(kind: str, df: DataFrame) -> DataFrame:
        """Rows under new ids: with _old, and _id and id of their own."""
        plain = df.drop("_id", "id")
        return numbered(plain, store.top(kind) + 1).withColumn("id", key_of(kind))

    known = store.read("concepts").filter((F.col("space") == space) & (F.length("canonical_id") > 0) & (F.col("state") != "purged")).groupBy("canonical_id").agg(F.min_by("id", "_id").alias("new"))
    met = materialize(rows["concepts"].join(known, "canonical_id").select(F.col("_old").alias("old"), "new"), "met")
    new = {"concepts": materialize(fresh("concepts", rows["concepts"].join(met.select(F.col("old").alias("_old")), "_old", "left_anti")), "new")}
    for k in ("assertions", "evidence", "activities"):
        new[k] = materialize(fresh(k, rows[k]), "new")
    pairs = met.unionByName(reduce(DataFrame.unionByName, [df.select(F.col("_old").alias("old"), F.col("id").alias("new")) for df in new.values()]))

    def rewritten(kind: str, df: DataFrame, pairs: DataFrame) -> DataFrame:
        """References replaced, by one join on the ids that the rows name."""
        columns = REFERENCES[kind]
        named = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")) if many else F.array(c), lambda x: F.regexp_extract(x, _KEY, 1)) for c, many in columns.items()]
        asked = df.select("_old", F.explode(F.array_distinct(F.flatten(F.array(*named)))).alias("old")).filter("old <> ''")
        ids = asked.join(pairs, "old").groupBy("_old").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_ids"))
        full = df.join(ids, "_old", "left").withColumn("_ids", F.coalesce("_ids", F.create_map().cast("map<string,string>")))
        return full.withColumns({c: _mapped(F.col(c), many, "_ids") for c, many in columns.items()}).drop("_ids").withColumn("space", F.lit(space))

    ends = rewritten("propositions", rows["propositions"], pairs).withColumn("tuple_key", tuple_key())
    same = store.read("propositions").filter((F.col("space") == space) & (F.col("state") != "purged")).groupBy("tuple_key").agg(F.min_by("id", "_id").alias("new"))
    ends = materialize(ends.join(same, "tuple_key", "left"), "ends")
    new["propositions"] = materialize(fresh("propositions", ends.filter("new is null").drop("new")), "new")
    pairs = pairs.unionByName(ends.filter("new is not null").select(F.col("_old").alias("old"), "new")).unionByName(new["propositions"].select(F.col("_old").alias("old"), F.col("id").alias("new")))
    pairs = materialize(pairs, "pairs")
    with store.transaction():
        for k, df in new.items():
            done = df if k == "propositions" else rewritten(k, df, pairs)
            store._append(k, done.withColumn("state", state(F.col("state"))).select(*[f.name for f in fields[k]], F.lit(1).alias("_version")))
    return pairs

