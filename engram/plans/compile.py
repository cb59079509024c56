"""Compiling queries to DataFrames.

A frame has one column for each variable (the key of an element, a literal's key, a
symbol) and one for each path of it that the query mentions, so that Catalyst sees
one plan, prunes the columns and pushes the fixed parts of patterns to the scans.
Plain patterns may be reordered by Catalyst; FILTER, NOT, OPTIONAL and UNION see
the solutions so far, in the order written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators import belief, history
from engram.operators.traverse import walk
from engram.plans import language as L
from engram.plans.language import QueryError
from engram.plans.store_view import KIND_OF, SEP, StoreView
from engram.runtime import materialize

_INNER = "␟"


@dataclass(frozen=True)
class Info:
    """kind: an element kind, ``any`` (element or literal), ``literal``, ``symbol``, ``belief``; nullable: may be unbound; ready: paths with a column, and their types."""

    kind: str
    nullable: bool = False
    ready: tuple[tuple[tuple[str, ...], str], ...] = ()
    type: str = "ref"


@dataclass
class Frame:
    df: DataFrame
    vars: dict[str, Info]


def _name(var: str, path: tuple[str, ...] = ()) -> str:
    return var + "".join(_INNER + p for p in path)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _paths(node: Any, out: dict[str, set]) -> None:
    if isinstance(node, L.Var):
        out.setdefault(node.name, set())
        if node.path:
            out[node.name].add(node.path)
    elif isinstance(node, (tuple, list)):
        for x in node:
            _paths(x, out)
    elif hasattr(node, "__dataclass_fields__"):
        for f in node.__dataclass_fields__:
            _paths(getattr(node, f), out)


class Compiler:
    def __init__(self, query: L.Query, view: StoreView):
        self.query, self.spark = query, view.spark
        if query.as_of:
            view = replace(view, coordinate=view.resolve(*query.as_of))
        self.view, self.paths = view, {}
        _paths((query.find, query.where, [v for v, _ in query.order]), self.paths)
        for e in query.find:
            if isinstance(e, L.Var) and not e.path:
                self.paths[e.name].add(("*",))
        name = query.epistemic.get("policy", "baseline")
        name = name.rpartition(":")[2]
        if name not in belief.POLICIES:
            raise QueryError(f"no policy {name}", "ProjectionPolicyUnavailable")
        self.policy = belief.POLICIES[name]
        custom = {k: v for k, v in query.epistemic.items() if k in ("accept", "material", "modes")}
        if custom:
            self.policy = self.policy.custom(**custom)

    # -- frames ---------------------------------------------------------------------------

    def join(self, a: Frame | None, b: Frame, how: str = "inner") -> Frame:
        if a is None:
            return b
        shared = [v for v in b.vars if v in a.vars]
        b_df = b.df.drop(*[c for c in b.df.columns if c in a.df.columns and c not in shared])
        if how == "left_anti":
            return Frame(self._match(a, replace_df(b, b.df.select(*map(_quoted, shared)).distinct()), shared, "left_anti"), a.vars)
        merged = dict(a.vars)
        for v, i in b.vars.items():
            if v in merged:
                old = merged[v]
                both = dict(old.ready) | dict(i.ready)
                kind = old.kind if old.kind != "any" else i.kind
                merged[v] = Info(kind, old.nullable if how == "left" else old.nullable and i.nullable, tuple(both.items()), old.type)
            else:
                merged[v] = replace(i, nullable=i.nullable or how == "left")
        return Frame(self._match(a, replace_df(b, b_df), shared, how), merged)

    def _match(self, a: Frame, b: Frame, shared: list[str], how: str) -> DataFrame:
        loose = [v for v in shared if a.vars[v].nullable or b.vars[v].nullable]
        if not shared:
            if how == "left_anti":
                return a.df.limit(0) if not b.df.isEmpty() else a.df
            return a.df.crossJoin(b.df) if how == "inner" else a.df.join(b.df, F.lit(True), "left")
        if not loose:
            return a.df.join(b.df, shared, how)
        if how != "inner":
            # rows of the left are numbered, so that the ways to agree below, hash joins all, tell which have found a partner
            left = Frame(materialize(a.df.withColumn("_row", F.monotonically_increasing_id()), "nullable"), a.vars)
            found = self._match(left, b, shared, "inner")
            if how == "left_anti":
                return left.df.join(found.select("_row").distinct(), "_row", "left_anti").drop("_row")
            own = [c for c in b.df.columns if c not in shared]
            return left.df.join(found.select("_row", *map(_quoted, own)), "_row", "left").select(*map(_quoted, a.df.columns), *map(_quoted, own))
        # a null agrees with anything: one hash join for each way the nullable variables can be null
        parts = []
        firm = [v for v in shared if v not in loose]
        for nulls in product(*[["both"] + ["left"] * a.vars[v].nullable + ["right"] * b.vars[v].nullable for v in loose]):
            x, y, on = a.df, b.df, list(firm)
            for v, n in zip(loose, nulls):
                if n == "both":
                    on.append(v)
                elif n == "left":
                    x, y = x.filter(_quoted(v).isNull()), y.withColumnRenamed(v, "_drop_" + v)
                else:
                    x, y = x.filter(_quoted(v).isNotNull()), y.filter(_quoted(v).isNull()).drop(v)
            met = x.join(y, on) if on else x.crossJoin(y)
            parts.append(met.drop(*["_drop_" + v for v in loose]))
        return reduce(lambda p, q: p.unionByName(q), parts)

    def union(self, a: Frame | None, b: Frame) -> Frame:
        if a is None:
            return b
        out = a.df.unionByName(b.df, allowMissingColumns=True)
        names = {**a.vars, **b.vars}
        merged = {}
        for v in names:
            i, j = a.vars.get(v), b.vars.get(v)
            if i and j:
                ready = {p: t for p, t in i.ready if p in dict(j.ready)}
                merged[v] = Info(i.kind if i.kind == j.kind else "any", i.nullable or j.nullable, tuple(ready.items()), i.type)
            else:
                merged[v] = replace(i or j, nullable=True)
        return Frame(out, merged)

    def ensure(self, frame: Frame, var: str) -> Frame:
        """Columns for all paths of a variable that the query mentions."""
        info = frame.vars.get(var)
        if info is None:
            return frame
        missing = [p for p in self.paths.get(var, ()) if p not in dict(info.ready)]
        if not missing or info.kind in ("literal", "symbol", "belief"):
            return frame
        kinds = [info.kind] if info.kind in KIND_OF.values() else list(KIND_OF.values())
        found, types = None, {}
        for k in kinds:
            cols = [self.view.column(k, p) for p in missing]
            part = self.view.rows(k).select(F.col("id").alias(var), *[(c.cast("string") if len(kinds) > 1 and t != "num" else c.cast("double") if t == "num" else c).alias(_name(var, p)) for p, (c, t) in zip(missing, cols)])
            types |= {p: (t if len(kinds) == 1 or t == "num" else "str") for p, (_, t) in zip(missing, cols) if p not in types or t != "str"}
            found = part if found is None else found.unionByName(part)
        return Frame(frame.df.join(found, var, "left"), {**frame.vars, var: replace(info, ready=(*info.ready, *types.items()))})

    # -- clauses --------------------------------------------------------------------------

    def solve(self, clauses: tuple) -> Frame | None:
        frame: Frame | None = None
        for c in clauses:
            match c:
                case L.Element():
                    frame = self.join(frame, self.element(c))
                case L.Tuple_():
                    frame = self.join(frame, self.tuple_(c, frame))
                case L.Structural():
                    frame = self.join(frame, self.structural(c))
                case L.Belief():
                    frame = self.belief(c, frame)
                case L.BeliefSlot():
                    frame = self.join(frame, self.slot(c, frame))
                case L.Filter(e):
                    frame = self.filter(e, frame)
                case L.Block(kind, inner):
                    solved = self.solve(inner)
                    if solved is None:
                        continue
                    if kind == "UNION":
                        frame = self.union(frame, solved)
                    elif frame is None:
                        frame = self.unit_against(kind, solved)
                    elif kind == "NOT":
                        frame = self.join(frame, solved, "left_anti")
                    elif any(v not in frame.vars for v in solved.vars):
                        frame = self.join(frame, solved, "left")
        return frame

    def unit_against(self, kind: str, solved: Frame) -> Frame:
        unit = Frame(self.spark.range(1).select(F.lit(1).alias("_unit")), {})
        return self.join(unit, solved, "left_anti" if kind == "NOT" else "left")

    def element(self, c: L.Element) -> Frame:
        kind, df = c.kind, self.view.rows(c.kind)
        keys = {k for k, _ in c.matcher}
        if not keys & {"state", "id"}:
            df = df.filter("state = 'active'")
        if self.query.for_time and kind == "ASSERTION":
            t = F.lit(self.query.for_time).cast("timestamp")
            df = df.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_until").isNull() | (t < F.col("valid_until"))))
        bound: dict[str, Info] = {}
        columns = []
        for k, v in c.matcher:
            col, type_ = self.view.column(kind, (k,) if k != "status" or kind != "CONCEPT" else ("lifecycle", "status"))
            if isinstance(v, L.Var):
                bound[v.name] = Info("any" if type_ == "ref" else "literal", False, (), type_)
                columns.append((v.name, col))
                df = df.filter(col.isNotNull())
            elif isinstance(v, tuple) and len(v) == 2 and v[0] == "id":
                df = df.filter(col == F.lit(v[1]))
            elif isinstance(v, tuple):
                df = df.filter(F.coalesce(F.array_contains(col, v[0]) if type_ == "arr" and len(v) == 1 else col.isin(list(v)), F.lit(False)) if v else F.lit(False))
            elif type_ == "arr":
                df = df.filter(F.array_contains(col, F.lit(v)))
            elif v is None:
                df = df.filter(col.isNull())
            else:
                df = df.filter(compare("==", (col, type_), literal(v)))
        wanted = sorted(self.paths.get(c.var, ()))
        cols = [(p, *self.view.column(kind, p)) for p in wanted]
        out = df.select(F.col("id").alias(c.var), *[col.alias(n) for n, col in columns], *[col.alias(_name(c.var, p)) for p, col, _ in cols])
        return Frame(out, {c.var: Info(kind, False, tuple((p, t) for p, _, t in cols)), **bound})

    def _ends(self, df: DataFrame, parts: list[tuple[Any, str]]) -> tuple[DataFrame, dict[str, Info]]:
        """Fix or bind the columns of an edge table."""
        seen: dict[str, Info] = {}
        columns = []
        for term, column in parts:
            if isinstance(term, L.Var):
                if term.path:
                    raise QueryError("a pattern binds whole variables")
                if term.name in seen:
                    df = df.filter(F.col(column) == F.col(dict((n, c) for n, c in columns)[term.name]))
                else:
                    seen[term.name] = Info("any")
                    columns.append((term.name, column))
            elif isinstance(term, L.Lit):
                df = df.filter(F.col(column) == F.lit(term_key(term.value))) if not isinstance(term.value, str) else df.filter(F.col(column).isin(term.value, term_key(term.value)))
        return df.select(*[F.col(c).alias(n) for n, c in columns], F.lit(1).alias("_unit")), seen

    def tuple_(self, c: L.Tuple_, frame: Frame | None) -> Frame:
        edges, p = self.view.edges(), c.predicate
        if p.symbols:
            edges = edges.filter(F.col("pred").isin(*p.symbols))
        if p.ranged:
            if c.var:
                raise QueryError("a walk binds no proposition", "Unsupported")
            return self._walk(c, frame, edges)
        out, seen = self._ends(edges, [(c.subject, "s"), (c.object, "o"), *([(L.Var(c.var), "p")] if c.var else []), *([(L.Var(p.var), "pred")] if p.var else [])])
        if c.var:
            seen[c.var] = Info("PROPOSITION")
        if p.var:
            seen[p.var] = Info("symbol", False, (), "str")
        return Frame(out.drop("_unit") if seen else out, seen)

    def _walk(self, c: L.Tuple_, frame: Frame | None, edges: DataFrame) -> Frame:
        def seeds(term: Any) -> DataFrame | None:
            if isinstance(term, L.Lit):
                return self.spark.createDataFrame([(term_key(term.value),)], "start string")
            if frame and term.name in frame.vars and not frame.vars[term.name].nullable:
                return frame.df.select(_quoted(term.name).alias("start")).distinct()
            return None

        p, from_subject, from_object = c.predicate, seeds(c.subject), seeds(c.object)
        if p.low == 0 and from_subject is None and from_object is None:
            raise QueryError("a walk of no hops needs a bound end", "ProjectionTargetUnbound")
        back = from_subject is None and from_object is not None
        if back:
            from_object = from_object.filter(~F.col("start").startswith("lit" + SEP))
        found = None
        for symbol in p.symbols:
            own = edges.filter(F.col("pred") == symbol)
            steps = own.select(F.col("o").alias("src"), F.col("s").alias("dst")) if back else own.select(F.col("s").alias("src"), F.col("o").alias("dst"))
            pairs = walk(steps, from_object if back else from_subject, p.low, p.high).select("start", "end")
            found = pairs if found is None else found.unionByName(pairs)
        found = found.distinct()
        found = found.select(F.col("end").alias("s"), F.col("start").alias("o")) if back else found.select(F.col("start").alias("s"), F.col("end").alias("o"))
        out, seen = self._ends(found, [(c.subject, "s"), (c.object, "o")])
        return Frame(out.drop("_unit") if seen else out, seen)

    def structural(self, c: L.Structural) -> Frame:
        out, seen = self._ends(self.view.links(c.field), [(c.subject, "s"), (c.object, "o")])
        return Frame(out.drop("_unit") if seen else out, seen)

    def _at(self) -> Column | None:
        return F.lit(self.query.for_time).cast("timestamp") if self.query.for_time else None

    def _belief_columns(self, var: str) -> list[tuple[tuple[str, ...], Column, str]]:
        known = {
            ("status",): (F.col("status"), "str"),
            ("support", "score"): (F.col("support"), "num"),
            ("opposition", "score"): (F.col("opposition"), "num"),
            ("support", "groups"): (F.col("support_voices"), "num"),
            ("opposition", "groups"): (F.col("opposition_voices"), "num"),
            ("support", "score_semantics"): (F.lit("normalized_support_not_probability"), "str"),
            ("policy", "id"): (F.col("policy"), "str"),
            ("*",): (F.to_json(F.struct("id", "status", "support", "opposition", "policy")), "str"),
        }
        return [(p, *known.get(p, (F.lit(None).cast("string"), "str"))) for p in sorted(self.paths.get(var, ()))]

    def belief(self, c: L.Belief, frame: Frame | None) -> Frame:
        cols = self._belief_columns(c.var)
        beliefs = self.view.beliefs(self.policy, self._at())
        if isinstance(c.target, L.Tuple_):
            hidden = replace(c.target, var="_belief_" + c.var)
            frame, target = self.join(frame, self.tuple_(hidden, frame)), hidden.var
        elif isinstance(c.target, L.Var):
            target = c.target.name
            if frame is None or target not in frame.vars:
                raise QueryError(f"?{target} is not bound", "ProjectionTargetUnbound")
        else:
            target = "_belief_" + c.var
            own = self.view.edges().filter(F.col("p") == c.target.value).select(F.col("p").alias(target))
            frame = self.join(frame, Frame(own, {target: Info("PROPOSITION")}))
        out = beliefs.select(F.col("id").alias(target), F.concat(F.lit("belief:"), "id").alias(c.var), *[x.alias(_name(c.var, p)) for p, x, _ in cols])
        return self.join(frame, Frame(out, {target: Info("PROPOSITION"), c.var: Info("belief", False, tuple((p, t) for p, _, t in cols))}))

    def slot(self, c: L.BeliefSlot, frame: Frame | None) -> Frame:
        if isinstance(c.subject, L.Var) and (frame is None or c.subject.name not in frame.vars) or len(c.predicate.symbols) != 1:
            raise QueryError("a slot needs a bound subject and one predicate", "ProjectionTargetUnbounded")
        edges = self.view.edges().select(F.col("p").alias("id"), F.col("s").alias("subject"), F.col("pred").alias("predicate"), F.col("o").alias("object"))
        rows = belief.slots(edges.filter(F.col("predicate") == c.predicate.symbols[0]), self.view.beliefs(self.policy, self._at()))
        known = {("accepted",): ("accepted", "num"), ("accepted_values",): ("accepted_values", "arr"), ("leading",): ("leading", "str"), ("contested",): ("contested", "bool"), ("*",): ("subject", "str")}
        cols = [(p, *known.get(p, ("subject", "str"))) for p in sorted(self.paths.get(c.var, ()))]
        picked = rows.select(F.col("subject").alias("s"), F.concat_ws("|", "subject", "predicate").alias(c.var), *[F.col(x).alias(_name(c.var, p)) for p, x, _ in cols])
        if isinstance(c.subject, L.Lit):
            df, seen = picked.filter(F.col("s") == term_key(c.subject.value)).drop("s"), {}
        else:
            df, seen = picked.withColumnRenamed("s", c.subject.name), {c.subject.name: Info("any")}
        return Frame(df, {**seen, c.var: Info("belief", False, tuple((p, t) for p, _, t in cols))})

    # -- filters --------------------------------------------------------------------------

    def filter(self, e: Any, frame: Frame | None) -> Frame:
        names: dict[str, set] = {}
        _paths(e, names)
        unbound = [n for n in names if frame is None or n not in frame.vars]
        if unbound:
            raise QueryError(f"?{unbound[0]} is not bound where it is filtered", "VariableUnbound")
        for n in names:
            frame = self.ensure(frame, n)
        return Frame(frame.df.filter(self.condition(e, frame)), frame.vars)

    def operand(self, x: Any, frame: Frame) -> tuple[Column, str]:
        if isinstance(x, L.Lit):
            return literal(x.value)
        info = frame.vars[x.name]
        if not x.path:
            return _quoted(x.name), info.type
        return (_quoted(_name(x.name, x.path)), dict(info.ready)[x.path]) if x.path in dict(info.ready) else (F.lit(None).cast("string"), "str")

    def condition(self, e: Any, frame: Frame) -> Column:
        match e:
            case L.Logic("and", parts):
                return reduce(Column.__and__, [self.condition(p, frame) for p in parts])
            case L.Logic("or", parts):
                return reduce(Column.__or__, [self.condition(p, frame) for p in parts])
            case L.Logic("not", (part,)):
                return ~self.condition(part, frame)
            case L.Compare(a, op, b):
                return compare(op, self.operand(a, frame), self.operand(b, frame))
            case L.Call(name, args):
                return self.call(name, args, frame)
        raise QueryError(f"no condition: {e!r}")

    def call(self, name: str, args: tuple, frame: Frame) -> Column:
        first = self.operand(args[0], frame)
        if name in ("IS_NULL", "IS_NOT_NULL"):
            return first[0].isNull() if name == "IS_NULL" else first[0].isNotNull()
        info = frame.vars.get(args[0].name) if isinstance(args[0], L.Var) and not args[0].path else None
        literal_key = F.coalesce(first[0].cast("string").startswith("lit" + SEP), F.lit(False)) if info and info.type == "ref" else F.lit(info is None)
        if name == "IS_LITERAL":
            return first[0].isNotNull() & (literal_key if info and info.type == "ref" else F.lit(True))
        if name == "IS_ELEMENT":
            return first[0].isNotNull() & (~literal_key if info and info.type == "ref" else F.lit(False))
        second = self.operand(args[1], frame) if len(args) > 1 else None
        if name == "IS_KIND":
            letters = {k.lower(): letter for letter, k in KIND_OF.items()}
            letter = letters.get(str(args[1].value).lower(), "?") if isinstance(args[1], L.Lit) else "?"
            return F.coalesce(first[0].cast("string").startswith(letter + "-"), F.lit(False))
        if name == "LITERAL_TYPE":
            got = F.when(literal_key, F.split(first[0].cast("string"), SEP)[1]) if info and info.type == "ref" else type_name(first)
            return got.isNotNull() if second is None else F.coalesce(got == second[0], F.lit(False))
        if second is None:
            raise QueryError(f"{name} takes two arguments")
        if name == "IN":
            values = args[1].value if isinstance(args[1], L.Lit) and isinstance(args[1].value, tuple) else None
            if values is None:
                return compare("==", first, second)
            return reduce(Column.__or__, [compare("==", first, literal(v)) for v in values]) if values else F.lit(False)
        text, other = shown(first), shown(second)
        if name == "CONTAINS":
            return F.coalesce(first[0].isNotNull() & second[0].isNotNull() & text.contains(other), F.lit(False))
        if name == "STARTS_WITH":
            return F.coalesce(text.startswith(other), F.lit(False))
        if name == "ENDS_WITH":
            return F.coalesce(text.endswith(other), F.lit(False))
        pattern = args[1].value if isinstance(args[1], L.Lit) else None
        if not isinstance(pattern, str) or re.search(r"\(\?[=!<]|\\[1-9]", pattern):
            raise QueryError("a pattern is a plain regular expression without look-around and back references", "Unsupported")
        return F.coalesce(first[0].isNotNull() & text.rlike(pattern), F.lit(False))

    # -- result ---------------------------------------------------------------------------

    def result(self) -> DataFrame:
        q = self.query
        frame = self.solve(q.where)
        if frame is None:
            frame = Frame(self.spark.range(1).select(F.lit(1).alias("_unit")), {})
        for e in [*q.find, *[v for v, _ in q.order]]:
            frame = self.ensure(frame, (e.var if isinstance(e, L.Aggregate) else e).name)
        aggregates = [e for e in q.find if isinstance(e, L.Aggregate)]
        if aggregates:
            if len(aggregates) < len(q.find) or q.order:
                raise QueryError("aggregates stand alone, without ORDER BY", "Unsupported")
            out = frame.df.agg(*[self.aggregate(e, frame).alias(label(e)) for e in aggregates])
            return out if q.limit is None or q.limit > 0 else out.limit(0)
        columns, names = [], {}
        for e in q.find:
            c, t = self.operand(L.Var(e.name, e.path or ("*",)), frame) if frame.vars.get(e.name) and not e.path and frame.vars[e.name].kind not in ("any", "literal", "symbol") else self.operand(e, frame) if e.name in frame.vars else (F.lit(None).cast("string"), "str")
            n = label(e)
            names[n] = names.get(n, 0) + 1
            columns.append((F.to_json(c) if t == "var" else c).alias(n if names[n] == 1 else f"{n}_{names[n]}"))
        limits = [x for x in (q.limit, self.view.max_results) if x is not None]
        df = frame.df
        if q.order or limits or q.cursor:
            keys = []
            for v, down in q.order:
                c, t = self.operand(v, frame)
                for k in ([c] if t != "var" else variant_order(c)):
                    keys.append(k.desc_nulls_last() if down else k.asc_nulls_last())
            ties = [_quoted(v).asc_nulls_last() for v in sorted(frame.vars)]
            df = df.orderBy(*keys, *ties)
            if q.cursor:
                df = df.offset(q.cursor)
            if limits:
                df = df.limit(min(limits))
        return df.select(*columns)

    def aggregate(self, e: L.Aggregate, frame: Frame) -> Column:
        if e.var.name not in frame.vars:
            c, t = F.lit(None).cast("double"), "num"
        else:
            c, t = self.operand(e.var, frame)
        if e.function == "COUNT":
            c = F.to_json(c) if t == "var" else c
            return F.countDistinct(c) if e.distinct else F.count(c)
        n = number((c, t))
        if e.distinct and e.function == "SUM":
            return F.coalesce(F.sum_distinct(n), F.lit(0.0))
        return {"SUM": lambda: F.coalesce(F.sum(n), F.lit(0.0)), "AVG": lambda: F.avg(n), "MIN": lambda: F.min(n), "MAX": lambda: F.max(n)}[e.function]()


def replace_df(frame: Frame, df: DataFrame) -> Frame:
    return Frame(df, frame.vars)


def label(e: Any) -> str:
    if isinstance(e, L.Aggregate):
        return "_".join([e.function.lower(), *(["distinct"] if e.distinct else []), e.var.name, *e.var.path])
    return "_".join([e.name, *e.path])


def term_key(value: Any) -> str:
    """The endpoint key of a fixed term: an element's key, or a literal's."""
    if isinstance(value, tuple) and value[0] == "id":
        return value[1]
    if isinstance(value, str) and re.fullmatch(r"[CPAEX]-\d+", value):
        return value
    if isinstance(value, bool):
        return SEP.join(["lit", "boolean", "", str(value).lower()])
    if isinstance(value, (int, float)):
        return SEP.join(["lit", "number", "", str(int(value)) if float(value).is_integer() else repr(float(value))])
    return SEP.join(["lit", "string", "", str(value)])


def literal(v: Any) -> tuple[Column, str]:
    if isinstance(v, bool):
        return F.lit(v), "bool"
    if isinstance(v, (int, float)):
        return F.lit(v), "num"
    if v is None:
        return F.lit(None).cast("string"), "str"
    if isinstance(v, tuple):
        return F.lit(v[1] if len(v) == 2 and v[0] == "id" else str(list(v))), "str"
    return F.lit(v), "str"


def _variant_type(c: Column) -> Column:
    return F.regexp_replace(F.schema_of_variant(c), r"\(.*", "")


def number(x: tuple[Column, str]) -> Column:
    c, t = x
    if t == "num":
        return c.cast("double")
    if t == "var":
        return F.when(_variant_type(c).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "TINYINT", "SMALLINT"), F.try_variant_get(c, "$", "double"))
    return F.lit(None).cast("double")


def shown(x: tuple[Column, str]) -> Column:
    c, t = x
    text = F.when(_variant_type(c) == "STRING", F.try_variant_get(c, "$", "string")).otherwise(F.to_json(c)) if t == "var" else F.to_json(c) if t == "arr" else c.cast("string")
    return F.coalesce(text, F.lit("null"))


def type_name(x: tuple[Column, str]) -> Column:
    c, t = x
    if t == "var":
        v = _variant_type(c)
        return F.when(v == "STRING", "string").when(v == "BOOLEAN", "boolean").when(number(x).isNotNull(), "number")
    return F.when(c.isNotNull(), {"num": "number", "bool": "boolean"}.get(t, "string"))


def variant_order(c: Column) -> list[Column]:
    """Booleans before numbers before strings before the rest."""
    v = _variant_type(c)
    rank = F.when(c.isNull() | (v == "VOID"), None).when(v == "BOOLEAN", 0).when(number((c, "var")).isNotNull(), 1).when(v == "STRING", 2).otherwise(3)
    return [rank, number((c, "var")), F.when(rank.isin(0, 2, 3), shown((c, "var")))]


def compare(op: str, a: tuple[Column, str], b: tuple[Column, str]) -> Column:
    """Typed and two-valued: a null compares to nothing, unlike types are only unequal."""
    (x, s), (y, t) = a, b
    both = x.isNotNull() & y.isNotNull()
    family = lambda k: "str" if k in ("str", "ref") else k
    if "var" in (s, t):
        as_text = lambda c, k: F.when(_variant_type(c) == "STRING", F.try_variant_get(c, "$", "string")) if k == "var" else c if family(k) == "str" else F.lit(None).cast("string")
        as_bool = lambda c, k: F.when(_variant_type(c) == "BOOLEAN", F.try_variant_get(c, "$", "boolean")) if k == "var" else c if k == "bool" else F.lit(None).cast("boolean")
        pairs = [(number(a), number(b)), (as_text(x, s), as_text(y, t)), (as_bool(x, s), as_bool(y, t))]
    elif family(s) != family(t):
        return F.coalesce(both, F.lit(False)) if op == "!=" else F.lit(False)
    else:
        pairs = [(x, y)]
    if op == "!=":
        return F.coalesce(both & ~reduce(Column.__or__, [F.coalesce(p == q, F.lit(False)) for p, q in pairs]), F.lit(False))
    apply = {"==": lambda p, q: p == q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
    return reduce(Column.__or__, [F.coalesce(apply(p, q), F.lit(False)) for p, q in pairs])


def run(view: StoreView, text: str, params: dict | None = None) -> DataFrame:
    """Parse and compile a query over a view of the store."""
    return Compiler(L.parse(text, params), view).result()
