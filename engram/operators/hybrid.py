"""Reciprocal rank fusion and the search pipeline over text, vectors and filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.bm25 import Bm25, bm25_search, boolean_search
from engram.operators.filters import where
from engram.operators.paging import candidates, query_ids, search_limit
from engram.operators.vectors import knn


def rrf(lists: Sequence[DataFrame], *, key: str = "_id", k: float = 60.0) -> DataFrame:
    """(key, score) of ranked lists (key, rank from 0): the sum of 1 / (k + rank); a k not above 0 becomes 60."""
    k = k if k > 0 else 60.0
    all_ = reduce(DataFrame.unionByName, [x.select(key, "rank") for x in lists])
    return all_.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def ranked(found: DataFrame, order: Sequence, key: str = "_id") -> DataFrame:
    """(key, rank from 0) of a list that has been cut to its best entries; at most 4,096 rows."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select(key, "rank")


def search(docs: DataFrame, *, text: str | None = None, vector: Sequence[float] | None = None, filter: Any = None, limit: int | None = None, logical: bool = False, key: str = "_id", text_column: str | list[str] | tuple = "text", vector_column: str | dict[str, int] = "embedding", metric: str = "euclidean", params: Bm25 = Bm25(), k: float = 60.0) -> DataFrame:
    """(key, score) in order of relevance.

    Each ranked list passes on ten times the limit; the filter applies after fusion,
    so fewer rows than the limit may remain. Only a filter: the smallest matching
    ids, score 0. Neither search nor filter: nothing.

    :param text_column: a column; a list of columns is one index of their texts joined,
        a tuple of such has a ranked list for each.
    :param vector_column: a column, or columns with their lengths, of which those as
        long as the query are searched, each for a ranked list. If none is, a search
        for text as well goes on without vectors, one for the vector alone is an error.
    """
    limit = search_limit(limit)
    top, lists = candidates(limit), []
    if text is not None:
        find = boolean_search if logical else bm25_search
        for column in text_column if isinstance(text_column, tuple) else (text_column,):
            lists.append(ranked(find(docs, text, key=key, text=column, k=top, params=params), [F.desc("score"), key], key))
    if vector is not None:
        columns = [vector_column] if isinstance(vector_column, str) else [c for c, n in vector_column.items() if n == len(vector)]
        if not columns and text is None:
            raise ValueError(f"no vectors of length {len(vector)}")
        for column in columns:
            lists.append(ranked(knn(docs, vector, top, key=key, vector=column, metric=metric), ["distance", key], key))
    if not lists:
        if filter is None or not limit:
            return docs.select(key, F.lit(0.0).alias("score")).limit(0)
        return query_ids(docs, filter, limit, key=key).withColumn("score", F.lit(0.0))
    found = rrf(lists, key=key, k=k)
    if filter is not None:
        found = found.join(where(docs, filter).select(key), key, "left_semi")
    return found.orderBy(F.desc("score"), key).limit(limit)
