"""Parsing and cleaning expressions for raw text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType, TimestampNTZType, TimestampType, DateType

from sessionlens.functions.numeric import nan_to_null

# Cell texts that the pandas CSV reader turns into a missing
# value by default (pandas 2.x ``na_values`` default set).
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

_INF = float("inf")


def null_if_na_text(c: Column) -> Column:
    """Raw cell text -> null when it is one of the missing-value markers.

    Applied to the raw text before any stripping, so `` NA`` stays text.
    """
    return F.when(~c.isin(NA_TEXTS), c)


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing Unicode whitespace; null stays null, blank -> ''."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strict_long(c: Column, name: str) -> Column:
    """Text -> bigint; '1.5' truncates to 1; null, junk or non-finite raise."""
    as_long = c.try_cast("bigint")
    as_double = c.try_cast("double")
    bad = c.isNull() | (
        as_long.isNull()
        & (as_double.isNull() | F.isnan(as_double) | (F.abs(as_double) == F.lit(_INF)))
    )
    value = F.coalesce(as_long, as_double.cast("bigint"))
    msg = F.concat(F.lit(f"{name}: not an integer: "), F.coalesce(c.cast("string"), F.lit("null")))
    return F.when(bad, F.raise_error(msg)).otherwise(value)


def coerce_double(c: Column) -> Column:
    """Text -> double; anything unparsable (and NaN) becomes null."""
    return nan_to_null(c.try_cast("double"))


# Spelling of a first cell (digits as 0) -> format of its whole column.
DATE_SPELLINGS = {
    "0000-00-00": "yyyy-MM-dd",
    "0000-00-00 00:00:00": "yyyy-MM-dd HH:mm:ss",
    "0000-00-00T00:00:00": "yyyy-MM-dd'T'HH:mm:ss",
    "0000-00-00 00:00": "yyyy-MM-dd HH:mm",
    "0000/00/00": "yyyy/MM/dd",
    "0000/00/00 00:00:00": "yyyy/MM/dd HH:mm:ss",
    "00/00/0000": "MM/dd/yyyy",
    "00/00/0000 00:00:00": "MM/dd/yyyy HH:mm:ss",
    "00/00/0000 00:00": "MM/dd/yyyy HH:mm",
    "00000000": "yyyyMMdd",
}


def date_format_of(df, col: str) -> str | None:
    """Format of a text column by its first value, one of the usual spellings; else None.

    A fraction of a second may follow a time.  Reads one row.
    """
    row = df.where(F.col(col).isNotNull()).select(F.translate(F.trim(col), "123456789", "000000000")).first()
    if row is None:
        return None
    text, _, fraction = row[0].partition(".")
    fmt = DATE_SPELLINGS.get(text)
    return f"{fmt}.{'S' * 9}" if fmt and fraction and set(fraction) == {"0"} and ":" in text else fmt if not fraction else None


def strict_timestamp(c: Column, name: str, fmt: str | None = None) -> Column:
    """Text -> timestamp_ntz; null stays null, text that is not a timestamp (of the format) raises."""
    parsed = c.try_cast("timestamp_ntz") if fmt is None else F.try_to_timestamp(F.trim(c), F.lit(fmt)).cast("timestamp_ntz")
    msg = F.concat(F.lit(f"{name}: not a timestamp: "), c.cast("string"))
    return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(msg)).otherwise(parsed)


def coerce_timestamp(df, col: str) -> Column:
    """Any column -> timestamp_ntz, unparsable values -> null."""
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, TimestampNTZType):
        return c
    if isinstance(dtype, (TimestampType, DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, StringType):
        return c.try_cast("timestamp_ntz")
    return c.cast("string").try_cast("timestamp_ntz")
