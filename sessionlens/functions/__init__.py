"""Column-expression helpers (all JVM-side, no Python UDFs)."""

from sessionlens.functions.cleaning import (
    NA_TEXTS,
    coerce_double,
    null_if_na_text,
    strict_long,
    strict_timestamp,
    coerce_timestamp,
    date_format_of,
    strip_ws,
)
from sessionlens.functions.numeric import clip01, finite_or_zero, nan_to_null, safe_div
from sessionlens.functions.timefn import duration_seconds, period_start, timestamp_text

__all__ = [
    "NA_TEXTS",
    "null_if_na_text",
    "strip_ws",
    "strict_long",
    "coerce_double",
    "strict_timestamp",
    "coerce_timestamp",
    "date_format_of",
    "safe_div",
    "clip01",
    "finite_or_zero",
    "nan_to_null",
    "duration_seconds",
    "period_start",
    "timestamp_text",
]
