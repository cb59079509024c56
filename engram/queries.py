"""Registry of the general queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engram import graph, maintenance, retrieval, writes

_MODULES = (retrieval, graph, writes, maintenance)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_filtered_text(spark, sf_dir)


def queries() -> dict:
    found: dict = {}
    for m in _MODULES:
        found |= m.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _MODULES:
        found |= m.oracle_sql()
    return found
