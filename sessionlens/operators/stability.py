"""Segment stability over time (shares, drift) and agreement measures (ARI)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sessionlens.functions import coerce_timestamp, period_start
from sessionlens.schema import assert_unique, require_columns

PSI_EPS = 1e-8

# Metric names of the stability summary, in report order.
SUMMARY_METRICS = [
    "temporal_l1_mean", "temporal_l1_max", "temporal_psi_mean", "temporal_psi_max",
    "bootstrap_ari_mean", "bootstrap_ari_min", "bootstrap_silhouette_mean", "bootstrap_silhouette_std",
]


def segment_shares(events: DataFrame, assignments: DataFrame, period: str = "M") -> DataFrame:
    """Active users per (period, segment), the period total and the share.

    Distinct (period, user) pairs come from a grouped pass (a very active user
    is collapsed on each map task), then meet the one-row-per-user assignments.
    The (period, segment) table is small, so the per-period total is a window.
    """
    require_columns(events, {"user_id", "date"}, "events")
    require_columns(assignments, {"user_id", "segment_id"}, "assignments")
    ev = events.select("user_id", coerce_timestamp(events, "date").alias("date")).where(F.col("date").isNotNull())
    active = ev.select(period_start(F.col("date"), period).alias("period"), "user_id").distinct()
    asg = assert_unique(assignments.select("user_id", F.col("segment_id").cast("int").alias("segment_id")),
                        ["user_id"], "assignments").where(F.col("segment_id").isNotNull())
    counts = active.join(asg, "user_id", "inner").groupBy("period", "segment_id").agg(
        F.count(F.lit(1)).alias("n_users_active")
    )
    total = F.sum("n_users_active").over(Window.partitionBy("period"))
    return counts.select(
        "period",
        "segment_id",
        "n_users_active",
        total.alias("n_users_active_total"),
        (F.col("n_users_active") / total).alias("share"),
    ).orderBy("period", "segment_id")


def segment_shares_of_periods(events: DataFrame, assignments: DataFrame, periods: tuple[str, ...] = ("W", "M")) -> DataFrame:
    """``segment_shares`` for several kinds of period (column ``period_kind``) from one scan of the events.

    The events are reduced once to distinct (user, day) pairs; these meet the assignments.
    A user's days in order open a period where the day before lies in an earlier
    one, so each (user, period) counts once without a set of all of them.  A
    period begins on a day, so no time of day is needed.
    """
    require_columns(events, {"user_id", "date"}, "events")
    require_columns(assignments, {"user_id", "segment_id"}, "assignments")
    ev = events.select("user_id", coerce_timestamp(events, "date").alias("date")).where(F.col("date").isNotNull())
    days = ev.select("user_id", period_start(F.col("date"), "D").alias("day")).distinct()
    asg = assert_unique(assignments.select("user_id", F.col("segment_id").cast("int").alias("segment_id")),
                        ["user_id"], "assignments").where(F.col("segment_id").isNotNull())
    before = F.lag("day").over(Window.partitionBy("user_id").orderBy("day"))
    kinds = F.array(*[F.struct(F.lit(p).alias("period_kind"), period_start(F.col("day"), p).alias("period"),
                               period_start(F.col("_before"), p).alias("before")) for p in periods])
    opened = F.explode(F.filter(kinds, lambda k: k["before"].isNull() | (k["before"] < k["period"])))
    days = days.withColumn("_before", before)
    active = days.join(asg, "user_id", "inner").select("segment_id", opened.alias("k")).select("segment_id", "k.period_kind", "k.period")
    counts = active.groupBy("period_kind", "period", "segment_id").agg(F.count(F.lit(1)).alias("n_users_active"))
    total = F.sum("n_users_active").over(Window.partitionBy("period_kind", "period"))
    return counts.select(
        "period_kind", "period", "segment_id", "n_users_active", total.alias("n_users_active_total"),
        (F.col("n_users_active") / total).alias("share"),
    ).orderBy("period_kind", "period", "segment_id")


def temporal_drift(shares: DataFrame) -> DataFrame:
    """L1 and PSI between each period and the previous observed one.

    One pass over the (period, segment) share table: every row is emitted
    once as "current" for its own period and once as "previous" for the next
    observed period (found with a range window over the period order), then
    the two sides are summed per (period, segment).  A segment missing on one
    side counts as share 0.  The share table has one row per (period,
    segment), so the un-partitioned window is over a small table.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    t = F.timestamp_diff("MICROSECOND", epoch, F.col("period").cast("timestamp_ntz"))
    s = shares.select("period", "segment_id", "share", t.alias("_t"))
    nxt = F.min("period").over(Window.orderBy("_t").rangeBetween(1, Window.unboundedFollowing))
    s = s.withColumn("_next", nxt)
    rows = F.array(
        F.struct(F.col("period").alias("period"), F.col("share").alias("a"), F.lit(0.0).alias("b"),
                 F.lit(None).cast("timestamp_ntz").alias("prev")),
        F.struct(F.col("_next").alias("period"), F.lit(0.0).alias("a"), F.col("share").alias("b"),
                 F.col("period").alias("prev")),
    )
    both = (
        s.select("segment_id", F.explode(rows).alias("r"))
        .select("segment_id", "r.*")
        .where(F.col("period").isNotNull())
        .groupBy("period", "segment_id")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("prev").alias("prev"))
    )
    diff = F.col("a") - F.col("b")
    out = both.groupBy("period").agg(
        F.max("prev").alias("prev_period"),
        F.sum(F.abs(diff)).alias("l1_drift"),
        F.sum(diff * F.ln((F.col("a") + PSI_EPS) / (F.col("b") + PSI_EPS))).alias("psi_drift"),
    )
    return out.where(F.col("prev_period").isNotNull()).select("period", "prev_period", "l1_drift", "psi_drift").orderBy("period")


def adjusted_rand_index(labels: DataFrame, true_col: str, pred_col: str, weight_col: str | None = None,
                        by: list[str] | None = None) -> DataFrame:
    """ARI from the (true, pred) contingency table (pair-counting form): one row, or one for each value of ``by``.

    Weighted rows count ``weight`` times (bootstrap draws).  Perfect agreement
    and degenerate inputs (no disagreeing pairs) give 1.0.
    """
    by = by or []
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    cont = labels.groupBy(*by, true_col, pred_col).agg(F.sum(w).alias("n_ij"))
    a = cont.groupBy(*by, true_col).agg(F.sum("n_ij").alias("a_i")).groupBy(*by).agg(F.sum(F.col("a_i") ** 2).alias("sa"))
    b = cont.groupBy(*by, pred_col).agg(F.sum("n_ij").alias("b_j")).groupBy(*by).agg(F.sum(F.col("b_j") ** 2).alias("sb"))
    c = cont.groupBy(*by).agg(F.sum("n_ij").alias("n"), F.sum(F.col("n_ij") ** 2).alias("sq"))
    # small aggregates side by side: joined on ``by`` and a constant
    one = F.lit(1).alias("_k")
    t = c.select(one, "*").join(a.select(one, "*"), ["_k", *by]).join(b.select(one, "*"), ["_k", *by])
    tp = F.col("sq") - F.col("n")
    fp = F.col("sb") - F.col("sq")
    fn = F.col("sa") - F.col("sq")
    tn = F.col("n") * F.col("n") - fp - fn - F.col("sq")
    ari = F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    )
    return t.select(*by, ari.alias("ari"))


def stability_summary(drift: DataFrame, bootstrap: DataFrame | None) -> DataFrame:
    """Eight fixed metrics; NaN when the underlying table is empty."""
    nan = F.lit(float("nan"))
    d = drift.agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("l1_drift").alias("temporal_l1_mean"),
        F.max("l1_drift").alias("temporal_l1_max"),
        F.avg("psi_drift").alias("temporal_psi_mean"),
        F.max("psi_drift").alias("temporal_psi_max"),
    )
    cols = [F.coalesce(F.col(m), nan).alias(m) for m in SUMMARY_METRICS[:4]]
    if bootstrap is not None:
        bt = bootstrap.agg(
            F.avg("ari_vs_baseline").alias("bootstrap_ari_mean"),
            F.min("ari_vs_baseline").alias("bootstrap_ari_min"),
            F.avg(F.when(~F.isnan("silhouette"), F.col("silhouette"))).alias("bootstrap_silhouette_mean"),
            F.stddev_samp(F.when(~F.isnan("silhouette"), F.col("silhouette"))).alias("bootstrap_silhouette_std"),
        )
        one = F.lit(1).alias("_k")
        d = d.select(one, "*").join(bt.select(one, "*"), "_k")
        cols += [F.coalesce(F.col(m), nan).alias(m) for m in SUMMARY_METRICS[4:]]
    else:
        cols += [nan.alias(m) for m in SUMMARY_METRICS[4:]]
    wide = d.select(*cols)
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                     for i, m in enumerate(SUMMARY_METRICS)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").orderBy("ord").drop("ord")
