"""Numeric expressions: zero-safe division, clipping, finiteness."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_INF = float("inf")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den; a zero or null denominator gives ``default``."""
    q = F.try_divide(num.cast("double"), F.when(den != 0, den.cast("double")))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def clip01(c: Column) -> Column:
    """Clip to [0, 1] keeping nulls (greatest/least alone would skip nulls)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def finite_or_zero(c: Column) -> Column:
    """Cast to double; null, NaN and +/-inf become 0.0."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(_INF)), F.lit(0.0)).otherwise(d)
