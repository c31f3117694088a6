"""Per-user feature table from sessions and labelled events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions import safe_div
from sessionlens.operators.labels import content_vocabulary

SESSION_FEATURES = (
    "n_sessions",
    "mean_session_duration",
    "purchase_rate_sessions",
    "add_to_cart_rate_sessions",
    "mean_events_per_session",
    "mean_unique_items_per_session",
)
EVENT_FEATURES = ("n_events", "purchase_rate_events", "active_days", "first_seen", "last_seen")
SHARE_PREFIX = "share_content_"
MAX_CONTENT_TYPES = 5000


@dataclass(frozen=True)
class UserFeatures:
    user_features: DataFrame


def share_column(content_type: str) -> str:
    return f"{SHARE_PREFIX}{content_type.lower()}"


def user_session_features(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id").agg(
        F.count("session_key").alias("n_sessions"),
        # durations are whole microseconds: average them exactly as integers
        (F.avg(F.round(F.col("session_duration_sec") * 1e6).cast("long")) / 1e6).alias("mean_session_duration"),
        F.avg(F.col("has_purchase").cast("double")).alias("purchase_rate_sessions"),
        F.avg(F.col("has_add_to_cart").cast("double")).alias("add_to_cart_rate_sessions"),
        F.avg("n_events").alias("mean_events_per_session"),
        F.avg("n_unique_items").alias("mean_unique_items_per_session"),
    )


def present_content_types(events: DataFrame) -> list[str]:
    """Content types present in the events; more than ``MAX_CONTENT_TYPES`` are refused (one column each)."""
    rows = events.select("content_type").where(F.col("content_type").isNotNull()).distinct().limit(MAX_CONTENT_TYPES + 1).collect()
    if len(rows) > MAX_CONTENT_TYPES:
        raise ValueError(f"more than {MAX_CONTENT_TYPES} content types")
    return sorted(r[0] for r in rows)


def user_event_features(events: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Event counts, purchase share, active days, first/last seen, content mix.

    One grouped pass: the content counts are conditional counts per known
    content type, so there is no pivot and no second aggregate.  Shares are
    counts over all non-null content types; entropy is -sum(p ln p) over p > 0.
    """
    vocabulary = sorted(vocabulary)
    counts = [F.count_if(F.col("content_type") == F.lit(v)).alias(f"_c{i}") for i, v in enumerate(vocabulary)]
    agg = events.groupBy("user_id").agg(
        F.count("type").alias("n_events"),
        F.avg((F.col("type") == F.lit("purchase")).cast("double")).alias("purchase_rate_events"),
        F.count_distinct(F.to_date("date")).alias("active_days"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
        F.count("content_type").alias("_total"),
        *counts,
    )
    shares = [safe_div(F.col(f"_c{i}"), F.col("_total")).alias(share_column(v)) for i, v in enumerate(vocabulary)]
    out = agg.select("user_id", *EVENT_FEATURES, *shares)
    terms = [F.when(F.col(share_column(v)) > 0, F.col(share_column(v)) * F.ln(F.col(share_column(v)))).otherwise(0.0)
             for v in vocabulary]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return out.withColumn("content_entropy", -total + F.lit(0.0))


def build_user_features(
    events: DataFrame,
    sessions: DataFrame,
    users: DataFrame,
    category_map: dict | None = None,
    present_only: bool = False,
) -> UserFeatures:
    """sessions-per-user JOIN events-per-user, LEFT JOIN users.ltv, zero-filled.

    Share columns cover every content type the labeller can emit (sorted), so
    the schema does not depend on the data; ``present_only=True`` keeps only
    types that occur (one small distinct job).
    """
    vocab = present_content_types(events) if present_only else content_vocabulary(category_map)
    s = user_session_features(sessions)
    e = user_event_features(events, vocab)
    u = users.select(F.col("id").alias("_uid"), "ltv")
    uf = s.join(e, "user_id", "inner")
    uf = uf.join(u, uf["user_id"] == u["_uid"], "left").drop("_uid")
    return UserFeatures(user_features=uf.na.fill(0))
