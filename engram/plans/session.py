"""Reading and writing a graph store in the languages of this package.

``query`` compiles to one plan over the store's tables. ``mutate`` makes one commit of
all clauses or none: new elements and upserts are few and made on the driver, while
selection blocks run as queries on the state before the transaction and change all
the elements they select at once, in plans.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from engram.functions import scalar
from engram.plans import language as L
from engram.plans.compile import Compiler, term_key
from engram.plans.language import Lit, QueryError, Var
from engram.plans.mutations import Actions, Apply, Clause, Object, parse_mutation
from engram.plans.store_view import KIND_OF, SEP, TABLES, StoreView
from engram.sources.collection import CollectionError
from engram.sources.graph_store import KINDS, TERMINAL, GraphStore

#: columns that queries know and a graph store doesn't keep
_ABSENT = {"created_at": "timestamp", "updated_at": "timestamp", "asserted_at": "timestamp", "retracted_at": "timestamp", "client_key": "string", "payload_mode": "string", "content_ref": "string"}


@dataclass
class GraphView(StoreView):
    """A graph store as queries see it."""

    store: GraphStore | None = None
    objects: tuple[str, ...] = ("attributes", "facets")

    def rows(self, kind: str) -> DataFrame:
        df = self.store.read(TABLES[kind], self.coordinate)
        df = df.withColumn("version", F.col("_version")).withColumns({c: F.lit(None).cast(t) for c, t in _ABSENT.items() if c not in df.columns})
        return df.filter(F.coalesce(self.visible[kind], F.lit(False))) if kind in self.visible else df

    def column(self, kind: str, path: tuple[str, ...]) -> tuple[Column, str]:
        if path == ("governance", "purged"):
            return F.when(F.col("state") == "purged", F.lit(True)), "bool"
        if path == ("governance", "content_digest"):
            return F.col("purged_digest"), "str"
        return super().column(kind, path)

    def resolve(self, how: str, value: Any) -> Any:
        last = (self.store.log.commits() or [0])[-1]
        if how == "TX":
            name, _, number = str(value).rpartition("#")
            if not number.isdigit() or not 1 <= int(number) <= last or name != "commit":
                raise QueryError(f"no transaction {value}", "TransactionUnknown")
            return int(number)
        if how == "SEQ":
            if int(value) > last:
                raise QueryError(f"the last commit is {last}", "HistoricalSnapshotUnavailable")
            return int(value)
        raise QueryError("commits of this store have no time", "Unsupported")


def _merged_json(facet: str | None, gone: tuple[str, ...]):
    """JSON object with members added and some removed; in a member object if a facet is named, which goes if it is empty."""

    @F.pandas_udf("string")
    def run(base: pd.Series, more: pd.Series) -> pd.Series:
        def one(b, m):
            whole = json.loads(b) if b else {}
            own = whole.get(facet, {}) if facet is not None else whole
            new = {k: v for k, v in {**own, **json.loads(m or "{}")}.items() if k not in gone}
            if new == own and (own or facet is None or facet not in whole):
                return b
            if facet is None:
                return json.dumps(new, ensure_ascii=False)
            rest = {k: v for k, v in whole.items() if k != facet}
            return json.dumps({**rest, facet: new} if new else rest, ensure_ascii=False)

        return pd.Series([one(None if pd.isna(b) else b, None if pd.isna(m) else m) for b, m in zip(base, more)], dtype=object)

    return run


def _plain(v: Any) -> Any:
    """A value of the language as JSON would have it."""
    if isinstance(v, Object):
        return {k: _plain(x) for k, x in v.members}
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def _variables(v: Any, out: dict[tuple, None]) -> None:
    if isinstance(v, Var):
        out.setdefault((v.name, v.path))
    elif isinstance(v, Apply):
        _variables(v.args, out)
    elif isinstance(v, Object):
        _variables([x for _, x in v.members], out)
    elif isinstance(v, (list, tuple)):
        for x in v:
            _variables(x, out)


def _other(name: str):
    return lambda k, _: k != F.lit(name)


def _less(name: str, key: str):
    return lambda k, v: F.when(k == F.lit(name), F.array_remove(v, key)).otherwise(v)


class Session:
    """One space of a graph store.

    :param types: concept types that may be created; null takes any.
    """

    def __init__(self, spark: SparkSession, path: str, space: str = "default", *, types: Iterable[str] | None = None, functional: tuple[str, ...] = ("status",), visible: dict[str, Column] | None = None, masked: dict | None = None):
        self.spark, self.space, self.store, self.types = spark, space, GraphStore(spark, path), None if types is None else set(types)
        self.view = GraphView(spark, path, dict(visible or {}), dict(masked or {}), functional=functional, store=self.store)

    # -- reading ----------------------------------------------------------------------------

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        return Compiler(L.parse(text, params), self.view).result()

    # -- writing ----------------------------------------------------------------------------

    def mutate(self, text: str, params: dict | None = None, *, dry_run: bool = False) -> dict:
        """Run a write; returns seq (null if nothing changed), written (elements by kind) and handles (name -> id)."""
        clauses = parse_mutation(text, params)
        if any(c.verb == "PURGE" for c in clauses):
            if len(clauses) > 1:
                raise QueryError("a purge is a transaction of its own", "Unsupported")
            return self._purge(clauses[0], dry_run)
        run = _Run(self, clauses)
        try:
            with self.store.transaction(dry_run=dry_run) as result:
                run.all()
        except CollectionError as e:
            raise QueryError(str(e), str(e).split(":")[0] if ":" in str(e) else "ConstraintViolation") from e
        return {**result, "handles": run.handles}

    def preview(self, text: str, params: dict | None = None) -> dict:
        """What a write would change."""
        return self.mutate(text, params, dry_run=True)

    def _purge(self, c: Clause, dry_run: bool) -> dict:
        policy = c.more.get("policy") or "deny_if_referenced"
        if policy not in ("deny_if_referenced", "tombstone_reference", "authorized_cascade"):
            raise QueryError(f"no reference policy {policy}", "ConstraintViolation")
        run = _Run(self, [c])
        kind, hit = run.selected(c)
        ids = [r.id for r in hit.limit(10_001).collect()]
        if len(ids) > 10_000:
            raise QueryError("a purge takes at most 10,000 elements; use GraphStore.purge for more", "ResourceExhausted")
        if dry_run or not ids:
            return {"seq": None, "written": {TABLES[kind]: len(ids)}, "handles": {}}
        try:
            seq = self.store.purge(TABLES[kind], F.col("id").isin(ids), policy)
        except CollectionError as e:
            raise QueryError(str(e), str(e).split(":")[0]) from e
        return {"seq": seq, "written": {TABLES[kind]: len(ids)}, "handles": {}}


class _Run:
    """The clauses of one transaction: creations first, then upserts and propositions, then the rest."""

    def __init__(self, session: Session, clauses: list[Clause]):
        self.session, self.store, self.clauses, self.handles = session, session.store, clauses, {}
        self.spark = session.spark
        last = (self.store.log.commits() or [0])[-1]
        # selections see the state before the transaction
        self.view = replace(session.view, coordinate=last)
        self.next: dict[str, int] = {}
        self.new: dict[str, list[dict]] = {}

    def all(self) -> None:
        order = lambda c: 0 if (c.verb, c.kind) == ("CREATE", "CONCEPT") else 1 if c.verb in ("UPSERT", "ENSURE") else 2
        clauses = sorted(self.clauses, key=order)
        for c in clauses:  # all new elements have their ids before any clause refers to them
            if c.verb in ("CREATE", "ASSERT"):
                if c.target.name in self.handles:
                    raise QueryError(f"?{c.target.name} is made twice", "InvalidSyntax")
                self.fresh(c.kind, c.target.name)
        for c in clauses:
            getattr(self, "do_" + c.verb.lower())(c)
        for kind in list(self.new):
            self.flush(kind)

    # -- names ------------------------------------------------------------------------------

    def fresh(self, kind: str, handle: str) -> tuple[int, str]:
        table = TABLES[kind]
        if table not in self.next:
            self.next[table] = self.store.top(table)
        self.next[table] += 1
        letter = next(letter for letter, k in KIND_OF.items() if k == kind)
        self.handles[handle] = f"{letter}-{self.next[table]}"
        return self.next[table], self.handles[handle]

    def key(self, v: Any) -> str:
        """The id that a reference stands for."""
        if isinstance(v, Var):
            if v.name not in self.handles:
                raise QueryError(f"?{v.name} is not bound", "VariableUnbound")
            return self.handles[v.name]
        value = v.value if isinstance(v, Lit) else v
        value = value[1] if isinstance(value, tuple) and len(value) == 2 and value[0] == "id" else value
        if not isinstance(value, str):
            raise QueryError("expected an element", "TypeMismatch")
        return value

    def there(self, kind: str, key: str) -> Any:
        letter, _, number = key.partition("-")
        if KIND_OF.get(letter) != kind or not number.isdigit():
            raise QueryError(f"{key} is no {kind.lower()}", "NotFoundOrNotVisible")
        row = self.read(kind).filter(F.col("_id") == int(number)).first()
        if row is None or row.state == "purged":
            raise QueryError(f"no element {key}", "NotFoundOrNotVisible")
        return row

    def put(self, kind: str, id_: int, values: dict[str, Any]) -> None:
        """One new element; those of a kind are written together, before the kind is next read."""
        self.new.setdefault(kind, []).append({"_id": id_, "space": self.session.space, "state": "active", **values})

    def flush(self, kind: str) -> None:
        rows = self.new.pop(kind, [])
        if not rows:
            return
        schema = StructType.fromDDL(f"_id long, {KINDS[TABLES[kind]]}")
        times = [f.name for f in schema if f.dataType.simpleString() == "timestamp"]
        plain = StructType([StructField(f.name, StringType() if f.name in times else f.dataType) for f in schema])
        df = self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], plain)
        self.store._append(TABLES[kind], df.withColumns({n: F.col(n).cast("timestamp") for n in times}).withColumn("_version", F.lit(1)))

    def read(self, kind: str) -> DataFrame:
        self.flush(kind)
        return self.store.read(TABLES[kind])

    # -- new elements -----------------------------------------------------------------------

    def type_of(self, name: Any) -> str:
        if not isinstance(name, str):
            raise QueryError("a type is a name", "TypeMismatch")
        if self.session.types is not None and name.rpartition("/")[2] not in self.session.types:
            raise QueryError(f"no type {name}", "SchemaSymbolNotFound")
        return name

    def content(self, a: Actions) -> dict[str, Any]:
        links: dict[str, list[str]] = {}
        for name, target in a.structural:
            links.setdefault(name, []).append(self.key(target))
        facets = {f: _plain(Object(m)) for f, m in a.facets}
        return {k: v for k, v in {"attributes": json.dumps(_plain(Object(a.attributes)), ensure_ascii=False) if a.attributes else None, "facets": json.dumps(facets, ensure_ascii=False) if facets else None, "structural": links or None}.items() if v is not None}

    def do_create(self, c: Clause) -> None:
        fields = {k: v if isinstance(v, Var) else _plain(v) for k, v in c.actions.fields}
        links: dict[str, list[str]] = {}
        for name, target in c.actions.structural:
            links.setdefault(name, []).append(self.key(target))
        need = lambda *names: [self.missing(n) for n in names if fields.get(n) is None]
        if c.kind == "CONCEPT":
            values = {"schema_ref": self.type_of(c.more["type"]), "name": c.more.get("name"), **fields, **self.content(c.actions)}
        elif c.kind == "EVIDENCE":
            need("evidence_class")
            values = {"evidence_class": fields["evidence_class"], "payload_inline": fields.get("payload"), "observed_at": fields.get("observed_at"), "generated_by": self.key(fields["generated_by"]) if fields.get("generated_by") else None, "status": "active"}
        elif c.kind == "ACTIVITY":
            need("activity_class")
            keys = lambda n, link: [self.key(x) for x in fields.get(n) or ()] + links.get(link, [])
            values = {"activity_class": fields["activity_class"], "started_at": fields.get("started_at"), "ended_at": fields.get("ended_at"), "status": fields.get("status") or "running", "inputs": keys("inputs", "input"), "output_keys": keys("outputs", "output")}
        else:
            need("proposition", "asserted_by", "stance", "mode")
            values = self.claim({**fields, "by": fields["asserted_by"]}, self.key(fields["proposition"]), links.get("evidence", []))
        self.put(c.kind, self.number(c.target.name), values)

    def number(self, handle: str) -> int:
        return int(self.handles[handle].partition("-")[2])

    @staticmethod
    def missing(name: str) -> None:
        raise QueryError(f"{name} is missing", "ConstraintViolation")

    def claim(self, fields: dict, proposition: str, evidence: list[str]) -> dict[str, Any]:
        confidence = fields.get("confidence")
        if confidence is not None and not 0 <= confidence <= 1:
            raise QueryError("a confidence lies between 0 and 1", "ConstraintViolation")
        return {"proposition_id": proposition, "asserted_by_key": "id" + SEP + self.key(fields["by"]), "stance": fields.get("stance") or "support", "mode": fields["mode"], "confidence": -1.0 if confidence is None else float(confidence), "valid_from": fields.get("valid_from"), "valid_until": fields.get("valid_until"), "evidence_refs": evidence, "status": "active", "supersedes": [], "superseded_by": []}

    def survivor(self, key: str) -> str:
        """What a merged concept stands for now."""
        for _ in range(64):
            if not key.startswith("C-") or key in self.handles.values():
                return key
            row = self.there("CONCEPT", key)
            if not row.merged_into:
                return key
            key = row.merged_into
        raise QueryError(f"the merges of {key} never end", "ConstraintViolation")

    def end(self, v: Any) -> str:
        """The endpoint key of a proposition's end."""
        if isinstance(v, Var) or isinstance(v, Lit) and term_key(v.value) == (v.value[1] if isinstance(v.value, tuple) else v.value):
            key = self.survivor(self.key(v))
            if key not in self.handles.values():
                self.there(KIND_OF.get(key[:1], "CONCEPT"), key)
            return "id" + SEP + key
        return term_key(v.value)

    def ensured(self, triple: tuple, handle: str | None, create_only: bool = False) -> str:
        s, predicate, o = triple
        subject, object_ = self.end(s), self.end(o)
        same = (F.col("space") == self.session.space) & (F.col("subject_key") == subject) & (F.col("predicate_ref") == predicate) & (F.col("object_key") == object_) & (F.col("state") != "purged")
        row = self.read("PROPOSITION").filter(same).orderBy("_id").first()
        if row is not None:
            if create_only:
                raise QueryError("the proposition is there", "VersionConflict")
            if handle:
                self.handles[handle] = row.id
            return row.id
        id_, key = self.fresh("PROPOSITION", handle or f"_{len(self.handles)}")
        from engram.sources.graph_store import tuple_key

        values = {"subject_key": subject, "predicate_ref": predicate, "object_key": object_}
        digest = self.spark.createDataFrame([(self.session.space, subject, predicate, object_)], "space string, subject_key string, predicate_ref string, object_key string").select(tuple_key()).first()[0]
        self.put("PROPOSITION", id_, {**values, "tuple_key": digest})
        return key

    def do_ensure(self, c: Clause) -> None:
        self.ensured(c.more["triple"], c.target.name, c.expect_version == 0)

    def do_assert(self, c: Clause) -> None:
        proposition = self.ensured(c.more["triple"], None)
        claim = {k: v if isinstance(v, Var) else _plain(v) for k, v in c.more["claim"].items()}
        key = self.handles[c.target.name]
        self.put("ASSERTION", self.number(c.target.name), self.claim(claim, proposition, [self.key(e) for e in claim.get("evidence") or ()]))
        if "old" in c.more:
            self.linked("ASSERTION", self.key(c.more["old"]), key)

    def do_upsert(self, c: Clause) -> None:
        match_ = {k: _plain(v) for k, v in c.more["match"].items()}
        for k in ("type", "key", "id"):
            if k in match_ and not isinstance(match_[k], str):
                raise QueryError(f"{k} is a text", "TypeMismatch")
        if "id" not in match_ and "key" not in match_:
            raise QueryError("MATCH names an id or a key", "ConstraintViolation")
        rows = self.read("CONCEPT").filter((F.col("space") == self.session.space) & (F.col("state") != "purged"))
        found = []
        if "id" in match_:
            found = [self.there("CONCEPT", match_["id"])]
        else:
            same = F.col("key") == match_["key"]
            if "type" in match_:
                same = same & (F.element_at(F.split("schema_ref", "/"), -1) == match_["type"].rpartition("/")[2])
            found = rows.filter(same).orderBy("_id").limit(2).collect()
        if len(found) > 1:
            raise QueryError(f"several concepts have the key {match_['key']}", "IdentityConflict")
        if found:
            row = found[0]
            if c.expect_version is not None and c.expect_version != row._version:
                raise QueryError(f"{row.id} is at version {row._version}", "VersionConflict")
            self.handles[c.target.name] = row.id
            if c.actions:
                self.write("CONCEPT", self.named([row.id]), c.actions, c.target.name)
            return
        if c.expect_version:
            raise QueryError("there is no such concept", "VersionConflict")
        if "type" not in match_:
            raise QueryError("a new concept needs a type", "SchemaSymbolNotFound")
        id_, _ = self.fresh("CONCEPT", c.target.name)
        self.put("CONCEPT", id_, {"schema_ref": self.type_of(match_["type"]), "key": match_["key"], **{k: _plain(v) for k, v in c.actions.fields}, **self.content(c.actions)})

    # -- changes of selected elements ---------------------------------------------------------

    def named(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def kind_of(self, c: Clause, name: str) -> str:
        def look(clauses: tuple) -> str | None:
            for x in clauses:
                if isinstance(x, L.Element) and x.var == name:
                    return x.kind
                if isinstance(x, L.Tuple_) and x.var == name:
                    return "PROPOSITION"
                if isinstance(x, L.Block) and (k := look(x.clauses)):
                    return k
            return None

        kind = look(c.where or ())
        if kind is None:
            raise QueryError(f"WHERE doesn't tell what ?{name} is", "VariableUnbound")
        return kind

    def rows_of(self, c: Clause, name: str, wanted: list[tuple]) -> DataFrame:
        """id, and v0, v1, ... for the wanted (variable, path), of what a WHERE block selects; one row an element."""
        query = L.Query((Var(name, ("id",)), *(Var(n, p) for n, p in wanted)), c.where)
        df = Compiler(query, self.view).result().toDF("id", *[f"v{i}" for i in range(len(wanted))])
        return df.dropDuplicates(["id"])

    def selected(self, c: Clause, wanted: list[tuple] = ()) -> tuple[str, DataFrame]:
        """(kind, rows of the target) after EXPECT and LIMIT."""
        if isinstance(c.target, Var) and c.where is not None:
            kind, rows = self.kind_of(c, c.target.name), self.rows_of(c, c.target.name, list(wanted))
        else:
            key = self.key(c.target)
            kind = c.kind or KIND_OF.get(key[:1])
            if kind is None:
                raise QueryError(f"no element {key}", "NotFoundOrNotVisible")
            if key not in self.handles.values():
                self.there(kind, key)
            if wanted:
                raise QueryError("an expression reads variables of a WHERE block", "VariableUnbound")
            rows = self.named([key])
        if c.kind and kind != c.kind:
            raise QueryError(f"{c.verb} takes {c.kind.lower()}", "TypeMismatch")
        if c.expect_version is not None or c.expect_state is not None:
            now = self.read(kind).join(rows.select("id"), "id", "left_semi")
            if c.expect_version is not None and not now.filter(F.col("_version") != c.expect_version).isEmpty():
                raise QueryError("an element has another version", "VersionConflict")
            held = F.col("status" if c.verb in ("RETRACT", "SUPERSEDE", "CORRECT", "TRANSITION") else "state")
            if c.expect_state is not None and not now.filter(~held.eqNullSafe(F.lit(c.expect_state))).isEmpty():
                raise QueryError("an element is in another state", "PreconditionFailed")
        if c.limit is not None:
            rows = rows.orderBy(F.split("id", "-")[1].cast("long")).limit(c.limit)
        return kind, rows

    def one(self, c: Clause, target: Any) -> str:
        """The one element a reference or a variable of the WHERE block stands for."""
        if isinstance(target, Var) and c.where is not None and target.name not in self.handles:
            ids = [r.id for r in self.rows_of(c, target.name, []).limit(2).collect()]
            if len(ids) != 1:
                raise QueryError(f"?{target.name} stands for {'several elements' if ids else 'none'}", "NotFoundOrNotVisible" if not ids else "CardinalityViolation")
            return ids[0]
        key = self.key(target)
        if key not in self.handles.values():
            self.there(c.kind, key)
        return key

    def value(self, v: Any, at: dict[tuple, int], numeric: bool = False) -> Column:
        """An expression over the columns v0, v1, ..."""
        if isinstance(v, Var):
            col = F.col(f"v{at[v.name, v.path]}")
            return F.expr(f"try_cast(v{at[v.name, v.path]} as double)") if numeric else col
        if isinstance(v, Apply):
            args = [self.value(x, at, True) for x in v.args]
            match v.function, len(args):
                case "ADD", 2:
                    return scalar.add(*args)
                case "MUL", 2:
                    return scalar.mul(*args)
                case "CLAMP", 3:
                    low, high = v.args[1:]
                    if not all(isinstance(x, (int, float)) for x in (low, high)) or low > high:
                        raise QueryError("the bounds of CLAMP are two numbers in order", "ConstraintViolation")
                    return scalar.clamp(args[0], float(low), float(high))
                case "COALESCE", n if n:
                    return F.coalesce(*args)
            raise QueryError(f"{v.function} takes other arguments", "InvalidSyntax")
        if numeric and (isinstance(v, bool) or not isinstance(v, (int, float)) and v is not None):
            raise QueryError("arithmetic takes numbers", "TypeMismatch")
        return F.lit(None).cast("double") if v is None and numeric else F.lit(float(v)) if numeric else F.lit(v)

    def json_text(self, v: Any, at: dict[tuple, int]) -> Column:
        if isinstance(v, Apply):
            return F.coalesce(F.to_json(F.struct(self.value(v, at).alias("x"))), F.lit("{}"))
        if isinstance(v, Var):
            raw = v.path[:1] in (("attributes",), ("facets",)) or not v.path
            text = F.col(f"v{at[v.name, v.path]}")
            return F.when(text.isNull(), '{"x":null}').otherwise(F.concat(F.lit('{"x":'), text.cast("string") if raw else F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2), F.lit("}")))
        return F.lit(json.dumps({"x": _plain(v)}, ensure_ascii=False))

    def members(self, pairs: tuple, at: dict[tuple, int]) -> Column:
        """The JSON object of computed members."""
        if not pairs:
            return F.lit("{}")
        inner = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), F.coalesce(F.nullif(F.regexp_replace(self.json_text(v, at), r'^\{"x":(.*)\}$', "$1"), F.lit("{}")), F.lit("null")) if not isinstance(v, Object) else F.lit(json.dumps(_plain(v), ensure_ascii=False))) for k, v in pairs]
        return F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))

    def write(self, kind: str, rows: DataFrame, a: Actions, name: str | None = None, at: dict[tuple, int] | None = None) -> None:
        at = at or {}
        if kind != "CONCEPT":
            code = "EpistemicRevisionRequired" if kind == "ASSERTION" else "ConstraintViolation"
            raise QueryError(f"{kind.lower()} elements aren't updated in place", code)
        now = self.read("CONCEPT").join(rows.withColumnRenamed("id", "_hit"), F.col("id") == F.col("_hit")).drop("_hit")
        sets: dict[str, Column] = {}
        for k, v in a.fields:
            sets[k] = F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, tuple) else self.value(v, at).cast("string")
        if a.attributes or a.no_attributes:
            sets["attributes"] = _merged_json(None, a.no_attributes)(F.col("attributes"), self.members(a.attributes, at))
        facets = F.col("facets")
        for f, members in a.facets:
            facets = _merged_json(f, ())(facets, self.members(members, at))
        for f, names in a.no_facets:
            facets = _merged_json(f, names)(facets, F.lit("{}")) if names else self.without(facets, f)
        if a.facets or a.no_facets:
            sets["facets"] = facets
        links = F.col("structural")
        none = F.array().cast("array<string>")
        for f, target in a.structural:
            old = F.coalesce(F.try_element_at(links, F.lit(f)), none)
            kept = F.map_filter(F.coalesce(links, F.create_map().cast("map<string,array<string>>")), _other(f))
            links = F.map_concat(kept, F.create_map(F.lit(f), F.array_union(old, F.array(F.lit(self.key(target))))))
        for f, target in a.no_structural:
            key = self.key(target)
            links = F.map_filter(F.transform_values(links, _less(f, key)), lambda _, v: F.size(v) > 0)
        if a.structural or a.no_structural:
            sets["structural"] = F.when(F.size(links) > 0, links)
        # maps can't be compared: the written rows are those whose text differs
        self.store._write("concepts", now, sets)

    @staticmethod
    def without(facets: Column, name: str) -> Column:
        return _merged_json(None, (name,))(facets, F.lit("{}"))

    def do_update(self, c: Clause) -> None:
        wanted: dict[tuple, None] = {}
        _variables([c.actions.fields, c.actions.attributes, c.actions.facets], wanted)
        kind, rows = self.selected(c, list(wanted))
        self.write(kind, rows, c.actions, None, {w: i for i, w in enumerate(wanted)})

    def change(self, kind: str, rows: DataFrame, sets: dict[str, Column], only: Column | None = None) -> None:
        now = self.read(kind).join(rows.select("id"), "id", "left_semi")
        self.store._write(TABLES[kind], now if only is None else now.filter(only), sets)

    def do_retract(self, c: Clause) -> None:
        kind, rows = self.selected(c)
        self.change(kind, rows, {"status": F.lit("retracted")}, F.col("status") == "active")

    def do_archive(self, c: Clause) -> None:
        kind, rows = self.selected(c)
        self.change(kind, rows, {"state": F.lit("archived")}, F.col("state") == "active")

    def do_tombstone(self, c: Clause) -> None:
        kind, rows = self.selected(c)
        self.change(kind, rows, {"state": F.lit("tombstoned")}, F.col("state") != "tombstoned")

    def do_set(self, c: Clause) -> None:
        kind, rows = self.selected(c)
        members = {k: _plain(v) for k, v in c.more["retention"].items()}
        held = members.get("legal_hold") is True
        self.change(kind, rows, {"retention": F.lit("legal_hold" if held else json.dumps(members, sort_keys=True))})

    def linked(self, kind: str, old: str, new: str) -> None:
        if old == new:
            raise QueryError("an element can't replace itself", "ConstraintViolation")
        self.flush(kind)
        pairs = self.spark.createDataFrame([(old, new)], "old string, new string")
        (self.store.supersede if kind == "ASSERTION" else self.store.correct_evidence)(pairs)

    def do_supersede(self, c: Clause) -> None:
        old, new = self.one(c, c.target), self.one(c, c.more["new"])
        if c.expect_state is not None and self.there(c.kind, old).status != c.expect_state:
            raise QueryError(f"{old} is in another state", "PreconditionFailed")
        self.linked(c.kind, old, new)

    do_correct = do_supersede

    def do_transition(self, c: Clause) -> None:
        kind, rows = self.selected(c)
        now = self.read("ACTIVITY").join(rows.select("id"), "id", "left_semi")
        if not now.filter(F.col("status").isin(*TERMINAL, "succeeded")).isEmpty():
            raise QueryError("a terminal activity is immutable", "ConstraintViolation")
        fields = {k: _plain(v) if not isinstance(v, Var) else v for k, v in c.actions.fields}
        sets = {"status": F.lit(c.more["status"])}
        if fields.get("ended_at"):
            sets["ended_at"] = F.coalesce("ended_at", F.lit(fields["ended_at"]).cast("timestamp"))
        if fields.get("outputs"):
            sets["output_keys"] = F.array(*[F.lit(self.key(x)) for x in fields["outputs"]]).cast("array<string>")
        self.change(kind, rows, sets)

    def do_merge(self, c: Clause) -> None:
        for side in (c.target, c.more["into"]):
            if isinstance(side, Var) and c.where is not None:
                own = [x for x in c.where if isinstance(x, L.Element) and x.var == side.name]
                if not any(k in ("key", "id", "canonical_id") for x in own for k, _ in x.matcher):
                    raise QueryError(f"?{side.name} is to be named by id or key", "IdentitySelectorRequired")
        source, target = self.one(c, c.target), self.one(c, c.more["into"])
        if c.expect_version is not None and self.there("CONCEPT", source)._version != c.expect_version:
            raise QueryError(f"{source} has another version", "VersionConflict")
        self.flush("CONCEPT")
        self.store.merge_concepts(self.spark.createDataFrame([(source, target)], "source string, target string"))
