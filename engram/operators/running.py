"""Running sums over more rows than one task should sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, value: str, by: list[str], bucket: Column, order: list[Column], name: str = "running") -> DataFrame:
    """Add the sum of ``value`` over the rows of the same ``by`` up to and with this one.

    ``bucket`` is a number that doesn't fall along ``order``; only the buckets' sums
    meet in one task per group, and each bucket's rows in one of their own. Null
    values count as 0; equal places in the order are summed in any order of theirs.
    """
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*by, "_bucket").agg(F.sum(F.coalesce(value, F.lit(0))).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_within", within).join(sums, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_within", "_before")
