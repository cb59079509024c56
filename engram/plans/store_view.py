"""Element kinds as the query language sees them: paths, edges, beliefs, visibility."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import belief, history
from engram.plans.language import QueryError
from engram.runtime import table
from engram.sources.store import LETTERS, _entry_key, key_of

TABLES = {"CONCEPT": "concepts", "PROPOSITION": "propositions", "ASSERTION": "assertions", "EVIDENCE": "evidence", "ACTIVITY": "activities"}
KIND_OF = {LETTERS[t]: k for k, t in TABLES.items()}
SEP = "\x1f"


def endpoint(c: Column) -> Column:
    """An endpoint key: the element's key, or the literal's key as it is."""
    return F.when(c.startswith("id" + SEP), F.substring(c, 4, 1 << 20)).otherwise(c)


def local(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


_COMMON = {
    ("space_id",): lambda: (F.col("space"), "str"),
    ("state",): lambda: (F.col("state"), "str"),
    ("lifecycle", "state"): lambda: (F.col("state"), "str"),
    ("created_at",): lambda: (_time("created_at"), "str"),
}
_VERSION = {("version",): lambda: (F.col("version"), "num"), ("lifecycle", "version"): lambda: (F.col("version"), "num")}
_STATUS = {("status",): lambda: (F.col("status"), "str"), ("lifecycle", "status"): lambda: (F.col("status"), "str")}
_same = lambda *names: {(n,): (lambda n=n: (F.col(n), "str")) for n in names}
_times = lambda *names: {(n,): (lambda n=n: (_time(n), "str")) for n in names}
#: path -> column and type (str, num, arr, ref: another element's key) by kind
PATHS: dict[str, dict[tuple, Any]] = {
    "CONCEPT": _COMMON | _VERSION | _same("key", "name", "canonical_id", "schema_ref") | _times("updated_at") | {("type",): lambda: (local(F.col("schema_ref")), "str"), ("aliases",): lambda: (F.col("aliases"), "arr"), ("attributes",): lambda: (F.col("attributes"), "str"), ("merged_into",): lambda: (F.nullif(F.col("merged_into"), F.lit("")), "ref")},
    "PROPOSITION": _COMMON | _same("tuple_key", "predicate_ref") | {("subject",): lambda: (endpoint(F.col("subject_key")), "ref"), ("object",): lambda: (endpoint(F.col("object_key")), "ref"), ("predicate",): lambda: (local(F.col("predicate_ref")), "str")},
    "ASSERTION": _COMMON | _VERSION | _STATUS | _same("stance", "mode", "client_key") | _times("asserted_at", "valid_from", "valid_until", "retracted_at") | {("proposition",): lambda: (F.col("proposition_id"), "ref"), ("asserted_by",): lambda: (endpoint(F.col("asserted_by_key")), "ref"), ("confidence",): lambda: (F.when(F.col("confidence") >= 0, F.col("confidence")), "num")},
    "EVIDENCE": _COMMON | _STATUS | _same("evidence_class", "payload_mode", "payload_inline", "content_ref") | _times("observed_at") | {("generated_by",): lambda: (F.col("generated_by"), "ref")},
    "ACTIVITY": _COMMON | _STATUS | _same("activity_class") | _times("started_at", "ended_at"),
}
#: reference lists that STRUCTURAL walks: field -> (kind, column, many)
LINKS = {
    "merged_into": ("CONCEPT", "merged_into", False),
    "proposition": ("ASSERTION", "proposition_id", False),
    "evidence": ("ASSERTION", "evidence_refs", True),
    "supersedes": ("ASSERTION", "supersedes", True),
    "superseded_by": ("ASSERTION", "superseded_by", True),
    "generated_by": ("EVIDENCE", "generated_by", False),
    "inputs": ("ACTIVITY", "inputs", True),
    "outputs": ("ACTIVITY", "output_keys", True),
}


@dataclass
class StoreView:
    """The store at a coordinate, as one reader may see it.

    :param visible: predicate by kind; rows it doesn't hold for don't exist to a query.
    :param masked: paths by kind that read as null, in filters and orders too.
    """

    spark: SparkSession
    path: str
    visible: dict[str, Column] = field(default_factory=dict)
    masked: dict[str, set[tuple[str, ...]]] = field(default_factory=dict)
    max_results: int | None = None
    coordinate: Any = None
    functional: tuple[str, ...] = ("status",)
    objects: tuple[str, ...] = ("attributes",)

    def rows(self, kind: str) -> DataFrame:
        """Distinct records of a kind with ``id``."""
        name = TABLES[kind]
        df = table(self.spark, self.path, name)
        if self.coordinate is not None:
            log = table(self.spark, self.path, "element_versions").filter(F.col("element").startswith(LETTERS[name] + "-"))
            parsed = history.as_of(log, self.coordinate).select(F.from_json("row", df.schema).alias("r"), "space", "version")
            own = [F.col(f"r.{f.name}").alias(f.name) for f in df.schema if f.name not in ("space", "version")]
            df = parsed.select(*own, "space", *(["version"] if "version" in df.columns else [])).filter("_id is not null")
        else:
            df = df.dropDuplicates(["_id"])
        df = df.withColumn("id", key_of(name))
        return df.filter(F.coalesce(self.visible[kind], F.lit(False))) if kind in self.visible else df

    def resolve(self, how: str, value: Any) -> Any:
        """The coordinate that AS OF names: a sequence number, or one for each space."""
        if how == "SEQ":
            return int(value)
        journal = table(self.spark, self.path, "tx_journal")
        if how == "TX":
            try:
                space, seq = history.seq_of_tx(journal, value)
            except history.HistoryError as e:
                raise QueryError(str(e), e.code) from e
            return self.spark.createDataFrame([(space, seq)], "space string, seq long")
        return history.seqs_at(journal, F.lit(value).cast("timestamp"))

    def column(self, kind: str, path: tuple[str, ...]) -> tuple[Column, str]:
        if path in (("id",), ()):
            return F.col("id"), "ref"
        if path == ("kind",):
            return F.lit(kind.lower()), "str"
        if path in self.masked.get(kind, ()) or path[:1] in self.masked.get(kind, ()):
            return F.lit(None).cast("string"), "str"
        if path == ("*",):
            return F.to_json(F.struct(F.col("id"), F.lit(kind.lower()).alias("kind"), *[c().__getitem__(0).alias("_".join(p)) for p, c in PATHS[kind].items() if len(p) == 1 and p not in self.masked.get(kind, ())])), "str"
        if path in PATHS[kind]:
            return PATHS[kind][path]()
        if kind == "CONCEPT" and path[0] in self.objects:
            way = "$" + "".join("['" + p.replace("'", "") + "']" for p in path[1:])
            return F.try_variant_get(F.try_parse_json(path[0]), way, "variant"), "var"
        return F.lit(None).cast("string"), "str"

    def edges(self) -> DataFrame:
        """Active propositions: p, s, pred, o."""
        df = self.rows("PROPOSITION").filter("state = 'active'")
        return df.select(F.col("id").alias("p"), endpoint(F.col("subject_key")).alias("s"), local(F.col("predicate_ref")).alias("pred"), endpoint(F.col("object_key")).alias("o"))

    def links(self, name: str) -> DataFrame:
        """(s, o) of a reference field of the active records."""
        if name not in LINKS:
            df = self.rows("CONCEPT").filter("state = 'active'")
            if "structural" not in df.columns:
                raise QueryError(f"no structural field {name}", "SymbolUnknown")
            return df.select(F.col("id").alias("s"), F.explode(F.try_element_at("structural", F.lit(name))).alias("o")).distinct()
        kind, column, many = LINKS[name]
        df = self.rows(kind).filter("state in ('active', 'merged')")
        df = df.select(F.col("id").alias("s"), (F.explode(column) if many else F.col(column)).alias("o"))
        return df.select("s", _entry_key(F.trim("o")).alias("o")).filter("o is not null").distinct()

    def claims(self) -> DataFrame:
        df = self.rows("ASSERTION")
        keys = F.array_distinct(F.array_compact(F.transform(F.coalesce("evidence_refs", F.array().cast("array<string>")), _entry_key)))
        return df.select("id", F.col("proposition_id").alias("target"), F.col("asserted_by_key").alias("actor"), "stance", "mode", "confidence", "status", "state", "valid_from", "valid_until", keys.alias("evidence"))

    def beliefs(self, policy: belief.Policy, at: Column | None) -> DataFrame:
        edges = self.edges().select(F.col("p").alias("id"), F.col("s").alias("subject"), F.col("pred").alias("predicate"), F.col("o").alias("object"))
        return belief.project(edges, self.claims(), policy=policy, functional=self.functional, at=at)
