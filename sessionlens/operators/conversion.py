"""Segment conversion: cart rate, purchase rate, efficiency and leakage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from sessionlens.functions import clip01, safe_div
from sessionlens.schema import assert_unique, require_columns


@dataclass(frozen=True)
class ConversionArtifacts:
    table: DataFrame
    quadrant: DataFrame
    leakage_size: DataFrame


def segment_conversion(
    sessions: DataFrame,
    assignments: DataFrame,
    id_col: str = "user_id",
    seg_col: str = "segment_id",
    has_atc_col: str = "has_add_to_cart",
    has_purchase_col: str = "has_purchase",
) -> DataFrame:
    """Per clustered segment (id >= 0): users, sessions, rates, efficiency, leakage.

    Sessions are first reduced to one row per user (partial aggregation, so a
    user with a huge number of sessions is pre-reduced before the shuffle);
    only then joined to the one-row-per-user assignments.  Segments without
    sessions keep null rates, efficiency 0 and leakage 1.
    """
    require_columns(sessions, {id_col, has_atc_col, has_purchase_col}, "sessions")
    require_columns(assignments, {id_col, seg_col}, "assignments")
    per_user = sessions.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col(has_atc_col).cast("int")).alias("_atc"),
        F.sum(F.col(has_purchase_col).cast("int")).alias("_pur"),
    )
    asg = assert_unique(assignments.select(id_col, F.col(seg_col).cast("int").alias(seg_col)), [id_col],
                        "assignments").where(F.col(seg_col).isNotNull())
    clustered = asg.where(F.col(seg_col) >= 0)
    seg_sessions = (
        per_user.join(clustered, id_col, "inner")
        .groupBy(seg_col)
        .agg(F.sum("_n").alias("n_sessions"), F.sum("_atc").alias("_atc"), F.sum("_pur").alias("_pur"))
        .select(
            seg_col,
            "n_sessions",
            (F.col("_atc") / F.col("n_sessions")).alias("atc_rate"),
            (F.col("_pur") / F.col("n_sessions")).alias("purchase_rate"),
        )
    )
    users_per_seg = clustered.groupBy(seg_col).agg(F.count_distinct(id_col).alias("n_users"))
    out = users_per_seg.join(seg_sessions, seg_col, "left")
    eff = clip01(safe_div(F.col("purchase_rate"), F.col("atc_rate")))
    out = out.withColumn("conversion_efficiency", eff).withColumn(
        "conversion_leakage", clip01(F.lit(1.0) - F.col("conversion_efficiency"))
    )
    return out.select(
        seg_col, "n_users", "n_sessions", "atc_rate", "purchase_rate", "conversion_efficiency", "conversion_leakage"
    ).orderBy(F.col("conversion_efficiency").desc(), F.col("n_users").desc(), F.col(seg_col).asc())


def quadrant_table(conversion: DataFrame, seg_col: str = "segment_id") -> DataFrame:
    """Cart rate vs purchase rate per segment, with the median split lines and bubble size.

    The input has one row per segment, so the un-partitioned windows are tiny.
    """
    w = Window.partitionBy()
    return conversion.select(
        seg_col,
        "n_users",
        "n_sessions",
        "atc_rate",
        "purchase_rate",
        F.median("atc_rate").over(w).alias("atc_rate_median"),
        F.median("purchase_rate").over(w).alias("purchase_rate_median"),
        (F.col("n_users") / F.max("n_users").over(w) * 600.0 + 40.0).alias("bubble_size"),
    )


def leakage_size_table(conversion: DataFrame, seg_col: str = "segment_id") -> DataFrame:
    return conversion.select(
        seg_col, "n_users", "conversion_leakage", "conversion_efficiency", "atc_rate", "purchase_rate"
    )


def run_conversion(sessions: DataFrame, assignments: DataFrame, **kw) -> ConversionArtifacts:
    table = segment_conversion(sessions, assignments, **kw)
    seg_col = kw.get("seg_col", "segment_id")
    return ConversionArtifacts(
        table=table, quadrant=quadrant_table(table, seg_col), leakage_size=leakage_size_table(table, seg_col)
    )
