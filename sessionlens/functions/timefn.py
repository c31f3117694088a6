"""Date/time expressions on timestamp_ntz columns (time-zone free)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PERIOD_UNITS = {"M": "month", "W": "week", "D": "day", "Y": "year", "Q": "quarter"}


def duration_seconds(start: Column, end: Column) -> Column:
    """end - start in seconds with microsecond precision, clipped at 0."""
    return F.greatest(F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6), F.lit(0.0))


def period_start(c: Column, period: str) -> Column:
    """Floor a timestamp to its period start ('M' month, 'W' Monday week, 'D' day)."""
    if period not in _PERIOD_UNITS:
        raise ValueError(f"period must be one of {sorted(_PERIOD_UNITS)}")
    day = F.to_date(c)
    if period == "D":
        return day.cast("timestamp_ntz")
    return F.trunc(day, _PERIOD_UNITS[period]).cast("timestamp_ntz")


def timestamp_text(c: Column) -> Column:
    """Timestamp as text, with microseconds only when the fraction is non-zero."""
    return F.when(
        F.date_format(c, "SSSSSS") == F.lit("000000"), F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    ).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
