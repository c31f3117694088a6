"""Data-quality report on the event log: shape, duplicates, nulls, integrity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions import timestamp_text
from sessionlens.schema import EVENT_KEY, SRC_ORDER

SAMPLE_ROWS = 50


@dataclass(frozen=True)
class DataQualityReport:
    summary: DataFrame
    details: dict


def _data_columns(events: DataFrame) -> list[str]:
    return [c for c in events.columns if c != SRC_ORDER]


def null_counts(events: DataFrame) -> DataFrame:
    """(column, null_count) for columns with nulls, most nulls first."""
    cols = _data_columns(events)
    wide = events.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    long = wide.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("null_count"))
                            for i, c in enumerate(cols)])).alias("r")
    ).select("r.column", "r.null_count")
    return long.where(F.col("null_count") > 0).orderBy(F.col("null_count").desc(), F.col("column").asc())


def duplicate_counts(events: DataFrame) -> DataFrame:
    """One row: full-row duplicates and key duplicates (rows beyond the first).

    Full rows are grouped once (partial aggregation collapses copies before
    the shuffle); the key groups are a roll-up of those groups.
    """
    full = events.groupBy(*[F.col(f"`{c}`") for c in _data_columns(events)]).agg(F.count(F.lit(1)).alias("_n"))
    by_key = full.groupBy(*EVENT_KEY).agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") - 1).alias("_copies"))
    return by_key.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("duplicate_event_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_events_by_key"),
    )


def _metric_rows(one_row: DataFrame, *metrics: tuple[int, str, F.Column]) -> DataFrame:
    rows = [F.struct(F.lit(o).alias("ord"), F.lit(name).alias("metric"), value.cast("string").alias("value"))
            for o, name, value in metrics]
    return one_row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def unknown_rows(events: DataFrame, dim: DataFrame, key: str, dim_key: str = "id") -> DataFrame:
    """Events whose ``key`` has no match in the dimension (null keys count as unknown)."""
    d = dim.select(F.col(dim_key).alias("_k")).distinct()
    return events.join(d, events[key] == d["_k"], "left_anti")


def _first_rows(df: DataFrame, n: int | None) -> DataFrame:
    order = [F.col(c) for c in ("user_id", "ga_session_id", "date", "item_id") if c in df.columns]
    if SRC_ORDER in df.columns:
        order.append(F.col(SRC_ORDER))
    return df if n is None else df.orderBy(*order).limit(n)


def check_events(events: DataFrame, items: DataFrame, users: DataFrame,
                 sample_rows: int | None = SAMPLE_ROWS) -> DataQualityReport:
    """``sample_rows``: rows of the unknown-reference details, None for all of them (unordered)."""
    cols = _data_columns(events)
    nulls = null_counts(events)
    missing_items = unknown_rows(events, items, "item_id")
    missing_users = unknown_rows(events, users, "user_id")

    # one pass with a flag per unknown reference, and one duplicate aggregate
    flagged = events
    for key, dim, flag in (("item_id", items, "_item"), ("user_id", users, "_user")):
        known = dim.select(F.col("id").alias(flag)).distinct()
        flagged = flagged.join(known, flagged[key] == known[flag], "left")
    has_date = "date" in events.columns
    has_dur = "session_duration_sec" in events.columns
    aggs = [F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("_item").isNull()).alias("_items"),
            F.count_if(F.col("_user").isNull()).alias("_users")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(cols)]
    n_null_cols = sum((F.col(f"_n{i}") > 0).cast("int") for i in range(len(cols))) if cols else F.lit(0)
    metrics = [(1, "n_events", F.col("n_events")), (4, "columns_with_nulls", n_null_cols),
               (5, "events_with_unknown_item", F.col("_items")), (6, "events_with_unknown_user", F.col("_users"))]
    if has_date:
        aggs += [F.min("date").alias("_min"), F.max("date").alias("_max")]
        metrics += [(7, "min_event_date", timestamp_text(F.col("_min"))), (8, "max_event_date", timestamp_text(F.col("_max")))]
    if has_dur:
        aggs.append(F.count_if(F.col("session_duration_sec") < 0).alias("_neg"))
        metrics.append((9, "negative_session_duration", F.col("_neg")))
    duplicates = [(o, name, F.col(name)) for o, name in ((2, "duplicate_event_rows"), (3, "duplicate_events_by_key"))]
    summary = _metric_rows(flagged.agg(*aggs), *metrics).unionByName(_metric_rows(duplicate_counts(events), *duplicates))
    details = {
        "event_nulls": nulls,
        "missing_items": _first_rows(missing_items, sample_rows),
        "missing_users": _first_rows(missing_users, sample_rows),
    }
    return DataQualityReport(summary=summary.orderBy("ord"), details=details)
