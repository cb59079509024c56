"""Limits, ordered id lists, keyset pages and point reads of a collection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.filters import where

DEFAULT_LIMIT, MAX_LIMIT, MAX_CANDIDATES, MAX_GET = 10, 1000, 4096, 1000


def search_limit(limit: int | None) -> int:
    """10 without a limit, at most 1,000."""
    return min(DEFAULT_LIMIT if limit is None else max(0, limit), MAX_LIMIT)


def candidates(limit: int) -> int:
    """Entries each ranked list passes on to fusion."""
    return min(limit * 10, MAX_CANDIDATES)


def query_ids(df: DataFrame, node: Any, limit: int | None = None, *, key: str = "_id") -> DataFrame:
    """The smallest matching ids, ascending; 1,000 without a limit."""
    return where(df, node).select(key).orderBy(key).limit(MAX_LIMIT if limit is None else limit)


def query_last_ids(df: DataFrame, node: Any, limit: int | None = None, *, key: str = "_id") -> DataFrame:
    """The largest matching ids, ascending."""
    return where(df, node).select(key).orderBy(F.desc(key)).limit(MAX_LIMIT if limit is None else limit).orderBy(key)


def query_all_ids(df: DataFrame, node: Any, *, key: str = "_id") -> DataFrame:
    return where(df, node).select(key).orderBy(key)


def keys_page(df: DataFrame, field: str, after: Any = None, limit: int = MAX_LIMIT) -> DataFrame:
    """Distinct keys of a field after a cursor, ascending; nulls are no keys."""
    kind = dict(df.dtypes)[field]
    keys = df.select(F.explode(F.map_keys(field) if kind.startswith("map") else field).alias("key") if kind.startswith(("array", "map")) else F.col(field).alias("key"))
    keys = keys.filter("key is not null") if after is None else keys.filter(F.col("key") > F.lit(after))
    return keys.distinct().orderBy("key").limit(limit)


def get_many(df: DataFrame, ids: Sequence[int], *, key: str = "_id") -> DataFrame:
    """A row for each id in the given order (``pos``), with nulls where there is none."""
    if len(ids) > MAX_GET:
        raise ValueError(f"at most {MAX_GET} ids")
    wanted = df.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "pos int, wanted long")
    # the id list is bounded by MAX_GET, so it and the documents found are small
    found = df.filter(F.col(key).isin(list(ids)))
    return wanted.join(found, F.col("wanted") == F.col(key), "left").orderBy("pos")


def page(df: DataFrame, order: Sequence, offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)
