"""Boolean filter algebra over the keys of a document.

A range query speaks about one key: a scalar field has one key, an array field
one for each element, a map field one for each of its keys; a document matches if
one of its keys does. A filter combines fields of the document. Both are
two-valued: a null has no key, so it never matches a range query (not even a
negated one), while a negated filter matches every document the inner one doesn't.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH, MAX_NODES, MAX_BRANCHES, MAX_INCLUDE = 64, 4096, 1024, 4096


class FilterError(ValueError):
    """The filter names an unknown field, has a literal of another type or is too large."""


@dataclass(frozen=True)
class Eq:
    value: Any


@dataclass(frozen=True)
class Gt:
    value: Any


@dataclass(frozen=True)
class Ge:
    value: Any


@dataclass(frozen=True)
class Lt:
    value: Any


@dataclass(frozen=True)
class Le:
    value: Any


@dataclass(frozen=True)
class Between:
    low: Any
    high: Any


@dataclass(frozen=True)
class Include:
    values: tuple


@dataclass(frozen=True)
class Prefix:
    value: str


@dataclass(frozen=True)
class AllOf:
    """One key that satisfies all; of none, nothing matches."""

    parts: tuple


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


@dataclass(frozen=True)
class NoneOf:
    """A key that doesn't satisfy the inner query."""

    part: Any


@dataclass(frozen=True)
class Field:
    """A field, or several of them (equality of the whole tuple only), with a range query."""

    name: str | tuple[str, ...]
    query: Any


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


_ACCEPTS = (
    (T.BooleanType, (bool,)),
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), (int,)),
    ((T.FloatType, T.DoubleType, T.DecimalType), (int, float)),
    (T.StringType, (str,)),
    (T.BinaryType, (bytes, bytearray)),
)


def _check(value: Any, kind: T.DataType, name: str) -> Any:
    for spark_types, python_types in _ACCEPTS:
        if isinstance(kind, spark_types):
            if not isinstance(value, python_types) or isinstance(value, bool) and bool not in python_types:
                raise FilterError(f"{name} has keys of type {kind.simpleString()}, not {type(value).__name__}")
    return value


def _key(query: Any, key: Column, kind: T.DataType, name: str) -> Column:
    lit = lambda v: F.lit(_check(v, kind, name))
    match query:
        case Eq(v):
            return key == lit(v)
        case Gt(v):
            return key > lit(v)
        case Ge(v):
            return key >= lit(v)
        case Lt(v):
            return key < lit(v)
        case Le(v):
            return key <= lit(v)
        case Between(a, b):
            return (key >= lit(a)) & (key <= lit(b))
        case Include(values):
            if len(values) > MAX_INCLUDE:
                raise FilterError(f"more than {MAX_INCLUDE} values for {name}")
            return key.isin([_check(v, kind, name) for v in values]) if values else F.lit(False)
        case Prefix(v):
            return key.startswith(lit(v))
        case AllOf(parts):
            return reduce(Column.__and__, [_key(p, key, kind, name) for p in parts]) if parts else F.lit(False)
        case AnyOf(parts):
            return reduce(Column.__or__, [_key(p, key, kind, name) for p in parts]) if parts else F.lit(False)
        case NoneOf(part):
            return ~_key(part, key, kind, name)
    raise FilterError(f"no range query: {query!r}")


def _parts(node: Any) -> tuple:
    match node:
        case And(p) | Or(p) | AllOf(p) | AnyOf(p):
            return tuple(p)
        case Not(p) | NoneOf(p):
            return (p,)
        case Field(_, q):
            return (q,)
    return ()


def check_size(node: Any) -> None:
    """Refuse filters that are too deep, too wide or too large."""
    seen, branches, level, depth = 0, 0, [node], 0
    while level:
        depth, seen = depth + 1, seen + len(level)
        branches += sum(len(_parts(n)) for n in level if isinstance(n, (And, Or, AllOf, AnyOf)))
        if depth > MAX_DEPTH or seen > MAX_NODES or branches > MAX_BRANCHES:
            raise FilterError("the filter is too complex")
        level = [p for n in level for p in _parts(n)]


def compile_filter(node: Any, schema: T.StructType, *, _checked: bool = False) -> Column:
    """The filter as a two-valued column that Catalyst can push to the scan."""
    if not _checked:
        check_size(node)
    again = lambda n: compile_filter(n, schema, _checked=True)
    match node:
        case And(parts):
            return reduce(Column.__and__, map(again, parts)) if parts else F.lit(False)
        case Or(parts):
            return reduce(Column.__or__, map(again, parts)) if parts else F.lit(False)
        case Not(part):
            return ~again(part)
        case Field(tuple() as names, Eq(values)):
            if len(names) != len(values):
                raise FilterError("a composite key takes one value for each field")
            return reduce(Column.__and__, [F.coalesce(F.col(n) == F.lit(_check(v, schema[n].dataType, n)), F.lit(False)) for n, v in zip(names, values)])
        case Field(str() as name, query):
            if name not in schema.names:
                raise FilterError(f"no field {name}")
            kind, c = schema[name].dataType, F.col(name)
            if isinstance(kind, T.ArrayType):
                found = F.exists(c, lambda x: x.isNotNull() & _key(query, x, kind.elementType, name))
            elif isinstance(kind, T.MapType):
                found = F.exists(F.map_keys(c), lambda x: _key(query, x, kind.keyType, name))
            else:
                found = c.isNotNull() & _key(query, c, kind, name)
            return F.coalesce(found, F.lit(False))
    raise FilterError(f"no filter: {node!r}")


def where(df: DataFrame, node: Any) -> DataFrame:
    return df.filter(compile_filter(node, df.schema))
