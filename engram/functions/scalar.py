"""Update expressions: finite arithmetic, clamping, first present value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(c: Column) -> Column:
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), F.raise_error(F.lit("the result is not finite"))).otherwise(c)


def add(a: Column, b: Column | float) -> Column:
    return _finite(a.cast("double") + (b if isinstance(b, Column) else F.lit(float(b))))


def mul(a: Column, b: Column | float) -> Column:
    return _finite(a.cast("double") * (b if isinstance(b, Column) else F.lit(float(b))))


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null."""
    if low > high:
        raise ValueError("the bounds of CLAMP are reversed")
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


coalesce = F.coalesce
