"""Session key and session roll-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions import duration_seconds
from sessionlens.schema import order_columns


@dataclass(frozen=True)
class Sessionized:
    events: DataFrame
    sessions: DataFrame


def session_key_expr() -> F.Column:
    return F.concat(F.col("user_id").cast("string"), F.lit("_"), F.col("ga_session_id").cast("string"))


def with_session_key(events: DataFrame) -> DataFrame:
    return events.withColumn("session_key", session_key_expr())


def _first_non_null(col: str, order: F.Column) -> F.Column:
    # min_by ignores rows whose ordering value is null
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), order))


def session_rollup(events: DataFrame) -> DataFrame:
    """One row per (user_id, ga_session_id).

    Grouped on the two numeric ids (partial aggregation before the shuffle, so
    a very large session is pre-reduced on every map task); the text key is
    derived after the aggregate.
    """
    order = F.struct(*order_columns(events))
    agg = events.groupBy("user_id", "ga_session_id").agg(
        F.min("date").alias("session_start"),
        F.max("date").alias("session_end"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("item_id").alias("n_unique_items"),
        F.count_if(F.col("type") == "purchase").alias("n_purchases"),
        F.count_if(F.col("type") == "add_to_cart").alias("n_add_to_cart"),
        _first_non_null("country", order).alias("country"),
        _first_non_null("device", order).alias("device"),
    )
    return agg.select(
        "user_id",
        "ga_session_id",
        session_key_expr().alias("session_key"),
        "session_start",
        "session_end",
        "n_events",
        "n_unique_items",
        "n_purchases",
        "n_add_to_cart",
        "country",
        "device",
        duration_seconds(F.col("session_start"), F.col("session_end")).alias("session_duration_sec"),
        (F.col("n_purchases") > 0).alias("has_purchase"),
        (F.col("n_add_to_cart") > 0).alias("has_add_to_cart"),
    )


def build_sessions(events: DataFrame) -> Sessionized:
    return Sessionized(events=with_session_key(events), sessions=session_rollup(events))
