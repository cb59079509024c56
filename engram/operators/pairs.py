"""Joins whose result within one key may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocked_join(a: DataFrame, b: DataFrame, keys: list[str], *, block: int = 1_000) -> DataFrame:
    """Inner join on ``keys`` that no task has to do for a hot key alone.

    The rows of a key are dealt to blocks of about ``block`` rows on each side, and
    every block of one side meets every block of the other: a key with n and m rows
    gives n * m / block**2 pieces of work that different tasks take, and each row is
    copied once for each block of the other side. Null keys match nothing.
    """
    sizes = a.groupBy(*keys).agg(F.count("*").alias("_na")).join(b.groupBy(*keys).agg(F.count("*").alias("_nb")), keys)
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = sizes.select(*keys, blocks("_na").alias("_na"), blocks("_nb").alias("_nb"))

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        place: Column = F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int")
        met = df.join(sizes, keys).withColumn(mine, place)
        return met.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_na", "_nb")

    return dealt(a, "_na", "_nb", "_pa", "_pb").join(dealt(b, "_nb", "_na", "_pb", "_pa"), [*keys, "_pa", "_pb"]).drop("_pa", "_pb")
