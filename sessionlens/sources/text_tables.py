"""The shared tables as all-text frames, as a CSV reader would give them.

Padding, missing-value markers, fractional ids, junk prices and missing types
are put in by rules on the ids, so that the parse layer has work to do.  Every
row of the tables is kept.  ``as_csv_files`` writes them as files for the loader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionlens.functions import null_if_na_text
from sessionlens.session import shared_path
from sessionlens.sources.csv_loader import parse_events, parse_items, parse_users
from sessionlens.sources.driver_tables import table


def _pick(key: str, texts: list) -> Column:
    """The text at place key % n of the list (None: the cell is missing)."""
    return F.element_at(F.array(*[F.lit(t).cast("string") for t in texts]), (F.col(key) % len(texts) + 1).cast("int"))


def _read(df: DataFrame) -> DataFrame:
    """What the CSV reader does to every cell: missing-value markers become null."""
    return df.select(*[null_if_na_text(F.col(c)).alias(c) for c in df.columns])


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    key = F.col("event_id")
    return ev.orderBy("event_id").select(
        F.concat(F.col("user_id").cast("string"), F.when(key % 9 == 0, ".7").otherwise("")).alias("user_id"),
        (key % 100).cast("string").alias("ga_session_id"),
        _pick("event_id", ["US", "  DE ", "NA", "", " N/A", " IN\t"]).alias("country"),
        _pick("event_id", ["mobile", " desktop", "null", "tablet  "]).alias("device"),
        F.when(key % 41 == 0, "NaN").otherwise(F.concat(F.lit(" "), "event_type")).alias("type"),
        F.get_json_object("props", "$.k").alias("item_id"),
        F.when(key % 53 == 1, "None").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        F.concat(key.cast("string"), F.when(key % 8 == 0, ".0").otherwise("")).alias("id"),
        F.concat(F.lit("  "), "p_name").alias("name"),
        F.when(key % 10 == 0, "n/a").otherwise(F.col("p_brand")).alias("brand"),
        F.col("p_size").cast("string").alias("variant"),
        F.concat("p_type", F.lit(" ")).alias("category"),
        _pick("p_partkey", ["free", "12.5", "NaN", "1e2", "", "-3", "7 usd"]).alias("price_in_usd"),
    )


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.cast("string").alias("id"),
        F.coalesce(_pick("c_custkey", [None, "unknown", None, "NA", "2.25"]), (key % 17).cast("string")).alias("ltv"),
        F.when(key % 6 == 5, "NULL").otherwise(F.concat(F.lit("01/0"), (key % 9 + 1).cast("string"), F.lit("/2024"))).alias("date"),
    )


def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(raw_events(spark, sf_dir))


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(raw_items(spark, sf_dir))


def text_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(raw_users(spark, sf_dir))


def as_csv_files(spark: SparkSession, sf_dir: str) -> str:
    """The three tables as headed CSV files under one new folder: what ``csv_loader.load_all`` reads."""
    folder = shared_path(spark, "raw-csv")
    for name, make in (("events1.csv", raw_events), ("items.csv", raw_items), ("users.csv", raw_users)):
        cells = make(spark, sf_dir).write.option("header", True).option("escape", '"')
        cells.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{name}")
    return folder


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_events(text_events(spark, sf_dir))


def parsed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_items(text_items(spark, sf_dir))


def parsed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_users(text_users(spark, sf_dir))
