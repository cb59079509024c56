"""Commands about the store: search, lists, descriptions, validation, batches of requests."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators import belief, bm25
from engram.plans import language as L
from engram.plans import mutations
from engram.plans.language import QueryError
from engram.plans.store_view import LINKS, TABLES, StoreView, local

MAX_SEARCH, MAX_OPERATIONS = 100, 256

#: what is searched of each kind
SEARCHED: dict[str, Callable[[], list[Column]]] = {
    "CONCEPT": lambda: [F.col("name"), F.array_join("aliases", "\n"), F.col("attributes")],
    "PROPOSITION": lambda: [F.col("predicate_ref")],
    "EVIDENCE": lambda: [F.col("payload_inline")],
}


def search(view: StoreView, term: str, target: str = "COGNITION", *, type: str | None = None, predicate: str | None = None, space: str | None = None, threshold: float = 0.0, limit: int | None = None, offset: int = 0, mode: str = "keyword") -> DataFrame:
    """(id, kind, score) of the active elements that hold the words of a term, best first, over all searched kinds.

    :param target: CONCEPT, PROPOSITION, EVIDENCE, or COGNITION for all three; claims and
        activities carry no text to be searched.

    Of each kind four times as many are ranked as asked for, then those of other spaces,
    types or predicates, inactive ones and those with a lower score are left out, so
    fewer than the limit (10, at most 100) may remain. What a view masks or hides isn't
    searched. Equal scores come in order of kind and id.
    """
    if mode != "keyword":
        raise QueryError(f"no {mode} search", "SearchModeUnsupported")
    kinds = list(SEARCHED) if target == "COGNITION" else [target]
    if any(k not in SEARCHED for k in kinds):
        raise QueryError(f"{target} has no text to search", "SearchIndexUnavailable")
    limit = min(10 if limit is None else limit, MAX_SEARCH)
    parts = []
    for kind in kinds:
        rows = view.rows(kind)
        hidden = {p[0] for p in view.masked.get(kind, ())}
        texts = [c for n, c in zip(("name", "aliases", "attributes") if kind == "CONCEPT" else ("predicate_ref",) if kind == "PROPOSITION" else ("payload_inline",), SEARCHED[kind]()) if n not in hidden]
        if not texts:
            continue
        rows = rows.withColumn("_text", F.concat_ws("\n", *texts))
        found = bm25.boolean_search(rows, term, key="id", text="_text", k=4 * (limit + offset)).filter(F.col("score") >= threshold)
        kept = rows.filter("state = 'active'")
        if space is not None:
            kept = kept.filter(F.col("space") == space)
        if type is not None:
            kept = kept.filter(F.lit(kind == "CONCEPT") & (local(F.col("schema_ref")) == type)) if kind == "CONCEPT" else kept.limit(0)
        if predicate is not None:
            kept = kept.filter(local(F.col("predicate_ref")) == predicate) if kind == "PROPOSITION" else kept.limit(0)
        parts.append(found.join(kept.select("id"), "id", "left_semi").select("id", F.lit(kind.lower()).alias("kind"), "score"))
    if not parts:
        return view.spark.createDataFrame([], "id string, kind string, score double")
    out = reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "kind", "id")
    return (out.offset(offset) if offset else out).limit(limit)


def _columns(view: StoreView) -> dict[str, Callable[[], DataFrame]]:
    every = lambda: reduce(DataFrame.unionByName, [view.rows(k).select("space") for k in TABLES])
    package = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    refs = lambda: view.rows("CONCEPT").select(F.col("schema_ref").alias("ref")).unionByName(view.rows("PROPOSITION").select(F.col("predicate_ref").alias("ref")))

    def keys(column: str) -> DataFrame:
        rows = view.rows("CONCEPT")
        if column not in rows.columns:
            return view.spark.createDataFrame([], "name string")
        held = F.json_object_keys(column) if column == "facets" else F.map_keys(column)
        return rows.select(F.explode(held).alias("name"))

    return {
        "SPACES": lambda: every().select(F.col("space").alias("name")),
        "SCHEMA_PACKAGES": lambda: refs().filter("ref like '%/%'").select(package(F.col("ref")).alias("name")),
        "TYPES": lambda: view.rows("CONCEPT").select(local(F.col("schema_ref")).alias("name")),
        "PREDICATES": lambda: view.rows("PROPOSITION").select(local(F.col("predicate_ref")).alias("name")),
        "FACETS": lambda: keys("facets"),
        "STRUCTURAL_FIELDS": lambda: keys("structural").unionByName(view.spark.createDataFrame([(n,) for n in LINKS], "name string")),
        "EPISTEMIC_POLICIES": lambda: view.spark.createDataFrame([(p.id,) for p in belief.POLICIES.values()], "name string"),
    }


def list_(view: StoreView, target: str, *, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(name, n): what there is of spaces, packages, types, predicates, facets, structural fields and policies, in order, as pages; n counts the elements."""
    known = _columns(view)
    if target not in known:
        raise QueryError(f"no list of {target}", "InvalidSyntax")
    out = known[target]().filter("name is not null").groupBy("name").agg(F.count("*").alias("n")).orderBy("name")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def counts(view: StoreView) -> DataFrame:
    """(kind, n) of the active elements of each kind."""
    parts = [view.rows(k).filter("state = 'active'").agg(F.lit(k.lower()).alias("kind"), F.count("*").alias("n")) for k in TABLES]
    return reduce(DataFrame.unionByName, parts)


def describe(view: StoreView, form: str, name: str | None = None) -> dict[str, Any]:
    """A description: PROTOCOL, CAPABILITIES, SPACE, TYPE, PREDICATE, POLICY, KIND, ACCESS."""
    match form:
        case "PROTOCOL":
            return {"kinds": list(L.KINDS), "aggregates": list(L.AGGREGATES), "functions": list(L.FUNCTIONS), "update_functions": list(mutations.FUNCTIONS), "max_bytes": L.MAX_BYTES, "max_depth": L.MAX_DEPTH}
        case "CAPABILITIES":
            return {"search_modes": ["keyword"], "policies": [p.id for p in belief.POLICIES.values()], "missing_stages": list(belief.MISSING_STAGES), "as_of": ["SEQ", "TX", "TIME"], "max_operations": MAX_OPERATIONS}
        case "SPACE":
            own = [view.rows(k).filter(F.col("space") == name) if name else view.rows(k) for k in TABLES]
            rows = reduce(DataFrame.unionByName, [r.groupBy("state").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k.lower())) for k, r in zip(TABLES, own)])
            return {"space": name, "elements": {f"{r.kind}/{r.state}": r.n for r in rows.orderBy("kind", "state").collect()}}
        case "TYPE" | "PREDICATE":
            kind, column = ("CONCEPT", "schema_ref") if form == "TYPE" else ("PROPOSITION", "predicate_ref")
            found = view.rows(kind).filter(local(F.col(column)) == name).groupBy(column).agg(F.count("*").alias("n")).orderBy(column).collect()
            if not found:
                raise QueryError(f"no {form.lower()} {name}", "SchemaSymbolNotFound")
            return {"name": name, "symbols": {r[0]: r.n for r in found}}
        case "POLICY":
            key = (name or "baseline").rpartition(":")[2]
            if key not in belief.POLICIES:
                raise QueryError(f"no policy {name}", "ProjectionPolicyUnavailable")
            p = belief.POLICIES[key]
            return {"id": p.id, "accept": p.accept, "material": p.material, "modes": list(p.modes), "missing_stages": list(belief.MISSING_STAGES)}
        case "KIND":
            from engram.plans.store_view import PATHS

            if name not in PATHS:
                raise QueryError(f"no kind {name}", "SchemaSymbolNotFound")
            return {"kind": name, "paths": sorted(".".join(p) for p in PATHS[name])}
        case "ACCESS":
            return {"restricted": sorted(view.visible), "masked": {k: sorted(".".join(p) for p in v) for k, v in view.masked.items()}, "max_results": view.max_results}
    raise QueryError(f"no description of {form}", "InvalidSyntax")


def validate(text: str, language: str | None = None, params: dict | None = None) -> dict[str, Any]:
    """Whether a text is a query (READ) or a write (WRITE); of another language than asked for it is not."""
    found = "READ" if text.lstrip().startswith("FIND") else "WRITE"
    report = {"language": found, "valid": True, "error": None, "message": None}
    try:
        L.parse(text, params) if found == "READ" else mutations.parse_mutation(text, params)
    except QueryError as e:
        report |= {"valid": False, "error": e.code, "message": str(e)}
    if language is not None and language != found:
        report |= {"valid": False, "error": "LanguageMismatch", "message": f"this is {found}, not {language}"}
    return report


def batch(session: Any, operations: Sequence[tuple[str, dict | None]], mode: str = "independent") -> list[dict[str, Any]]:
    """Run queries and writes one after the other: ``independent``, or in ``sequence``, which ends at the first that fails. One commit of all isn't offered: that is MUTATE."""
    if len(operations) > MAX_OPERATIONS:
        raise QueryError(f"at most {MAX_OPERATIONS} operations", "ResourceExhausted")
    if mode not in ("independent", "sequence"):
        raise QueryError(f"no mode {mode}", "Unsupported")
    out: list[dict[str, Any]] = []
    for text, params in operations:
        if mode == "sequence" and out and "error" in out[-1]:
            out.append({"error": "Skipped"} if out[-1]["error"] == "Skipped" else {"error": "Skipped"})
            continue
        try:
            out.append({"result": session.query(text, params) if text.lstrip().startswith("FIND") else session.mutate(text, params)})
        except QueryError as e:
            out.append({"error": e.code, "message": str(e)})
    return out
