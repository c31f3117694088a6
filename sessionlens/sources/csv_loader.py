"""Load the raw events / items / users CSV files.

Every column is read as text (no schema inference), then cast column by
column: ids strictly (junk or null raises), prices and ltv leniently (junk ->
null), timestamps strictly.  Extra columns pass through as text.  The source
order of each row is kept in ``src_order`` (file path, block start, row id),
which is what "first" and "latest" mean when rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlens.functions import (
    coerce_double,
    date_format_of,
    null_if_na_text,
    strict_long,
    strict_timestamp,
    strip_ws,
)
from sessionlens.operators.cleaning import DedupReport, clean_events, first_per_id, latest_per_id
from sessionlens.schema import (
    REQUIRED_EVENTS_COLS,
    REQUIRED_ITEMS_COLS,
    REQUIRED_USERS_COLS,
    SRC_ORDER,
    require_columns,
)


@dataclass(frozen=True)
class LoadedData:
    events: DataFrame
    items: DataFrame
    users: DataFrame
    dedup: DedupReport | None = None


def read_text_csv(spark: SparkSession, path: str, name: str, multiline: bool = False) -> DataFrame:
    """All-text CSV read with missing-value markers turned into nulls.

    ``multiline=True`` accepts quoted fields with line breaks; Spark then reads
    each file whole (no splitting), so it is off by default.
    """
    try:
        raw = (spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", multiline)
               .option("escape", '"').csv(path))
        raw.schema  # resolve now so a missing path fails here
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"{name} file not found: {path}") from exc
        raise
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select(*[null_if_na_text(F.col(f"`{c}`")).alias(c) for c in raw.columns], order.alias(SRC_ORDER))


def _typed(df: DataFrame, casts: dict) -> DataFrame:
    return df.select(*[casts[c].alias(c) if c in casts else F.col(f"`{c}`") for c in df.columns])


def parse_events(raw: DataFrame, date_format: str | None = None) -> DataFrame:
    require_columns(raw, REQUIRED_EVENTS_COLS, "events")
    casts = {c: strict_long(F.col(c), c) for c in ("user_id", "ga_session_id", "item_id")}
    casts.update({c: strip_ws(F.col(c)) for c in ("country", "device", "type")})
    casts["date"] = strict_timestamp(F.col("date"), "date", date_format or date_format_of(raw, "date"))
    return _typed(raw, casts)


def parse_items(raw: DataFrame) -> DataFrame:
    require_columns(raw, REQUIRED_ITEMS_COLS, "items")
    casts = {"id": strict_long(F.col("id"), "id"), "price_in_usd": coerce_double(F.col("price_in_usd"))}
    casts.update({c: strip_ws(F.col(c)) for c in ("name", "brand", "variant", "category")})
    return _typed(raw, casts)


def parse_users(raw: DataFrame, date_format: str | None = None) -> DataFrame:
    require_columns(raw, REQUIRED_USERS_COLS, "users")
    casts = {
        "id": strict_long(F.col("id"), "id"),
        "ltv": F.coalesce(coerce_double(F.col("ltv")), F.lit(0.0)),
        "date": strict_timestamp(F.col("date"), "date", date_format or date_format_of(raw, "date")),
    }
    return _typed(raw, casts)


def load_events(spark: SparkSession, path: str, date_format: str | None = None,
                report: DedupReport | None = None, multiline: bool = False) -> DataFrame:
    """Parsed, cleaned, de-duplicated events; ``report`` receives the removed-row count.

    Without ``date_format`` the first date's spelling holds for the whole column.
    """
    return clean_events(parse_events(read_text_csv(spark, path, "events", multiline), date_format), report)


def load_items(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return first_per_id(parse_items(read_text_csv(spark, path, "items", multiline)))


def load_users(spark: SparkSession, path: str, date_format: str | None = None, multiline: bool = False) -> DataFrame:
    return latest_per_id(parse_users(read_text_csv(spark, path, "users", multiline), date_format))


def load_all(
    spark: SparkSession,
    raw_dir: str,
    events_file: str = "events1.csv",
    items_file: str = "items.csv",
    users_file: str = "users.csv",
    date_format: str | None = None,
    multiline: bool = False,
) -> LoadedData:
    base = raw_dir.rstrip("/")
    report = DedupReport()
    return LoadedData(
        events=load_events(spark, f"{base}/{events_file}", date_format, report, multiline),
        items=load_items(spark, f"{base}/{items_file}", multiline),
        users=load_users(spark, f"{base}/{users_file}", date_format, multiline),
        dedup=report,
    )
