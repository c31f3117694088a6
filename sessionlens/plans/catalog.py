"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

All queries read the shared parquet tables through the adapters in
``sources.driver_tables`` and run over the whole tables.  Double columns are
rounded half-up to 6 places (and -0.0 cleared) for the cross-engine value
hash; the operators themselves return full precision.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from sessionlens.operators import bootstrap, cleaning, conversion, features, labels, paths, quality, segments, sessions, stability
from sessionlens.plans import pipeline
from sessionlens.session import shared_path, written
from sessionlens.sources import csv_loader, driver_tables as dt, sinks, text_tables

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            # the same IEEE steps as the SQL side (Spark's round() is decimal HALF_UP,
            # DuckDB's rounds the binary value: they disagree on exact ties)
            scale = float(10 ** digits)
            r = F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
            c = (F.when(F.isnan(c) | (F.abs(c) >= F.lit(1e9)), c).otherwise(r) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


# ------------------------------------------------------------------ inputs
def events_clean(spark, sf):
    return cleaning.clean_events(dt.raw_events(spark, sf))


def items_first(spark, sf):
    return cleaning.first_per_id(dt.items(spark, sf))


def users_latest(spark, sf):
    return cleaning.latest_per_id(dt.users(spark, sf))


def events_labeled(spark, sf):
    return labels.add_labels(events_clean(spark, sf), items_first(spark, sf), dt.PART_CATEGORY_MAP).events


def sessions_of(spark, sf):
    return sessions.session_rollup(events_labeled(spark, sf))


def assignments_of(spark, sf):
    # every user with a complete event; de-duplication keeps one row of each key, so it loses no user
    return dt.deterministic_assignments(cleaning.drop_incomplete_events(dt.raw_events(spark, sf)))


def user_features_of(spark, sf):
    ev = events_labeled(spark, sf)
    return features.build_user_features(
        ev, sessions.session_rollup(ev), users_latest(spark, sf), dt.PART_CATEGORY_MAP
    ).user_features


def written_once(df: DataFrame) -> DataFrame:
    """A user-level table that several jobs read: written once (Parquet), so the events are derived once."""
    return written(df, "users")


def m_events_labeled(spark, sf):
    ev = cleaning.clean_events(dt.monthly_events(spark, sf))
    return labels.add_labels(ev, items_first(spark, sf), dt.PART_CATEGORY_MAP).events


def m_assignments(spark, sf):
    return dt.deterministic_assignments(cleaning.drop_incomplete_events(dt.monthly_events(spark, sf)))


def session_sizes(raw):
    """Per-session size and time span of the raw events: an upper bound on the
    cleaned sizes, which is all the hot-session split needs (scan + partial
    aggregate, no de-duplication)."""
    return raw.groupBy("user_id", "ga_session_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("date").alias("session_start"), F.max("date").alias("session_end"))


def journeys_of(spark, sf, **cfg):
    cfg = paths.JourneyConfig(**cfg)
    events = events_clean if cfg.step_mode == "event_type" else events_labeled  # labels only where steps need them
    return paths.build_session_journeys(events(spark, sf), cfg, session_sizes(dt.raw_events(spark, sf)))


def _jout(j):
    return j.drop("steps")


def _path_rows(j):
    return j.select("path", "n_steps", "has_add_to_cart", "has_purchase")


def zscores(spark, sf):
    uf = written_once(user_features_of(spark, sf))
    return segments.standardize(uf, segments.feature_columns(uf))


def _labelled_z(spark, sf):
    return written_once(zscores(spark, sf).join(assignments_of(spark, sf), "user_id"))


def _nearest(spark, sf):
    """Nearest centroid where centroids = mean z-vector of each deterministic segment.

    Centroid index = deterministic segment id + 1 (0..4).
    """
    zl = _labelled_z(spark, sf)
    cols = segments.feature_columns(zl)
    cents = segments.label_centroids(zl, cols, "segment_id")
    out = segments.assign_nearest(zl.withColumnRenamed("segment_id", "true_segment"), cols,
                                  [c for _, c in cents], "_idx", "distance_sq")
    # centre i is the mean of deterministic segment cents[i][0]; report it as that id + 1
    ids = F.array(*[F.lit(int(label) + 1) for label, _ in cents])
    return out.withColumn("segment_id", F.element_at(ids, F.col("_idx") + 1).cast("int")).drop("_idx")


def q_nearest(spark, sf):
    return _nearest(spark, sf).select("user_id", "segment_id", "distance_sq")


def q_inertia(spark, sf):
    zl = _labelled_z(spark, sf)
    cols = segments.feature_columns(zl)
    cents = dict(segments.label_centroids(zl, cols, "segment_id"))
    return segments.inertia(zl, cols, "segment_id", cents)


def q_silhouette(spark, sf):
    zl = _labelled_z(spark, sf)
    return segments.silhouette_sq_euclidean(zl, segments.feature_columns(zl), "segment_id")


def q_outlier(spark, sf):
    return segments.outlier_policy(q_nearest(spark, sf).select("user_id", "segment_id"), 0.15)


def q_renumber(spark, sf):
    return segments.renumber(q_outlier(spark, sf))


def q_profile(spark, sf):
    uf = user_features_of(spark, sf)
    return segments.segment_profile(uf, assignments_of(spark, sf), segments.feature_columns(uf))


def q_conversion(spark, sf):
    return conversion.segment_conversion(sessions_of(spark, sf), assignments_of(spark, sf))


def q_dq(spark, sf, raw: bool):
    ev = dt.raw_events(spark, sf) if raw else events_clean(spark, sf)
    rep = quality.check_events(ev, items_first(spark, sf), users_latest(spark, sf))
    return rep.summary.select("metric", "value")


def q_transition_matrix(spark, sf):
    return paths.transition_matrix(paths.transition_counts(journeys_of(spark, sf)))


def q_lift(spark, sf):
    return paths.segment_path_lift(journeys_of(spark, sf), assignments_of(spark, sf))


def q_shares_week(spark, sf):
    return stability.segment_shares(events_clean(spark, sf), assignments_of(spark, sf), "W")


def q_shares_month(spark, sf):
    return stability.segment_shares(cleaning.clean_events(dt.monthly_events(spark, sf)), m_assignments(spark, sf), "M")


def q_shares_of_periods(spark, sf):
    """Shares per week, month and day of the monthly events, from one scan of them."""
    return stability.segment_shares_of_periods(
        cleaning.clean_events(dt.monthly_events(spark, sf)), m_assignments(spark, sf), ("W", "M", "D"))


def q_drift_summary(spark, sf):
    s = stability.stability_summary(stability.temporal_drift(q_shares_month(spark, sf)), None)
    return s.where(F.col("metric").startswith("temporal_"))


def q_ari(spark, sf):
    n = _nearest(spark, sf)
    return stability.adjusted_rand_index(n, "true_segment", "segment_id")


def q_user_event(spark, sf):
    ev = events_labeled(spark, sf)
    return features.user_event_features(ev, labels.content_vocabulary(dt.PART_CATEGORY_MAP))


def q_m_sessions(spark, sf):
    return sessions.session_rollup(m_events_labeled(spark, sf))


def q_m_user_features(spark, sf):
    ev = m_events_labeled(spark, sf)
    return features.build_user_features(ev, sessions.session_rollup(ev), users_latest(spark, sf),
                                        dt.PART_CATEGORY_MAP).user_features


def q_m_journeys(spark, sf):
    events = cleaning.clean_events(dt.monthly_events(spark, sf))
    return paths.build_session_journeys(events, paths.JourneyConfig(),
                                        session_sizes(dt.monthly_events(spark, sf)))


# ------------------------------------------------------------------ modelling (rows-only checks)
def _segmentation(spark, sf, **kw):
    uf = written_once(user_features_of(spark, sf))
    return segments.segment_users(uf, segments.feature_columns(uf), **kw)


def q_kmeans_segments(spark, sf):
    return _segmentation(spark, sf, k_range=range(3, 8)).assignments


def q_k_selection(spark, sf):
    return _segmentation(spark, sf, k_range=range(3, 8)).model_info


def q_bootstrap(spark, sf):
    uf = written_once(user_features_of(spark, sf))
    res = segments.segment_users(uf, segments.feature_columns(uf), k_range=range(3, 8))
    return bootstrap.bootstrap_stability(uf, res.assignments, res.feature_columns, res.chosen_k)


RUNS = range(1, 21)


def _bootstrap_weights(users):
    """(user_id, w): draws of every user in each of the twenty bootstrap samples."""
    return bootstrap.drawn_users(users.select("user_id"), len(RUNS), 0.8, 42)


def q_bootstrap_draws(spark, sf):
    """Draw counts of every drawn user in each bootstrap sample."""
    drawn = _bootstrap_weights(users_latest(spark, sf).select(F.col("id").alias("user_id")))
    runs = drawn.select("user_id", F.posexplode("w").alias("run", "draws"))
    return runs.select("user_id", (F.col("run") + 1).alias("run"), "draws").where("draws > 0")


def q_bootstrap_sizes(spark, sf):
    """Draws and drawn users of each bootstrap sample: exactly floor(0.8 N) draws."""
    return q_bootstrap_draws(spark, sf).groupBy("run").agg(F.sum("draws").alias("n_draws"), F.count("user_id").alias("n_drawn"))


def q_bootstrap_ari(spark, sf):
    """Agreement of each bootstrap sample's nearest centres with the labels, each copy counted."""
    near = written_once(_nearest(spark, sf).select("user_id", "true_segment", "segment_id"))
    rows = near.join(_bootstrap_weights(near), "user_id").select("true_segment", "segment_id", F.posexplode("w").alias("run0", "n"))
    rows = rows.where("n > 0").withColumn("run", F.col("run0") + 1)
    return stability.adjusted_rand_index(rows, "true_segment", "segment_id", "n", ["run"])


def q_pipeline(spark, sf):
    return pipeline.run_on_driver_tables(spark, sf).conversion.table


def q_lloyd_step(spark, sf):
    """Centres after one k-means step from the means of the deterministic segments."""
    moved = _nearest(spark, sf)
    return moved.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n_users"), *[F.avg(c).alias(c) for c in segments.feature_columns(moved)])


MIN_SESSIONS = 7  # leaves some users of every table unclustered


def q_kmeans_invariants(spark, sf):
    """One row of truths that hold for any right k-means segmentation, whatever its labels."""
    uf = written_once(user_features_of(spark, sf))
    cols = segments.feature_columns(uf)
    res = segments.segment_users(uf, cols, min_sessions=MIN_SESSIONS, renumber_segments=False)
    eligible = uf.where(F.col("n_sessions") >= MIN_SESSIONS)
    z = segments.standardize(eligible, cols)
    nearest = segments.assign_nearest(z, cols, res.centers, "nearest", "d2").join(res.assignments, "user_id")
    centers = F.array(*[F.array(*map(F.lit, c)) for c in res.centers])
    means = nearest.groupBy("segment_id").agg(F.array(*[F.avg(c) for c in cols]).alias("m"))
    gap = F.zip_with("m", F.element_at(centers, F.col("segment_id") + 1), lambda a, b: F.abs(a - b))
    gaps = means.agg(F.max(F.array_max(gap)).alias("gap"), F.min("segment_id").alias("low"), F.max("segment_id").alias("high"))
    fit = nearest.agg(F.count_if(F.col("nearest") != F.col("segment_id")).alias("off"))
    rest = uf.where(F.col("n_sessions") < MIN_SESSIONS).join(res.assignments, "user_id", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("segment_id") == -1).alias("n_out"))
    info = sorted((r.k, r.silhouette, r.inertia) for r in res.model_info.collect())  # one row per k
    best = max(info, key=lambda r: (r[1], -r[0]))[0]
    falls = all(b[2] <= a[2] for a, b in zip(info, info[1:], strict=False))
    off, gap, out = fit.first(), gaps.first(), rest.first()  # one row each
    return spark.createDataFrame([(
        off.off == 0, gap.gap < 1e-2, gap.low == 0 and gap.high == res.chosen_k - 1, 0 < out.n == out.n_out,
        best == res.chosen_k, falls,
    )], "labels_are_nearest boolean, centers_are_means boolean, ids_are_contiguous boolean, "
        "others_are_minus_one boolean, chosen_k_is_best boolean, cost_falls_with_k boolean")


def q_dq_durations(spark, sf):
    """Quality summary of events that carry a duration, some of them negative."""
    ev = events_clean(spark, sf).withColumn("session_duration_sec", (F.col("src_order") % 7 - 1).cast("double"))
    return quality.check_events(ev, items_first(spark, sf), users_latest(spark, sf)).summary.where(
        F.col("metric").isin("n_events", "negative_session_duration")).select("metric", "value")


def q_conversion_idle(spark, sf):
    """Conversion with a segment whose users have no sessions."""
    idle = users_latest(spark, sf).where(F.col("id") % 4 == 0).select(
        (F.col("id") + 5 * F.lit(dt.DUPLICATE_OFFSET).cast("bigint")).alias("user_id"), F.lit(9).cast("int").alias("segment_id"))
    return conversion.segment_conversion(sessions_of(spark, sf), assignments_of(spark, sf).unionByName(idle))


def q_standardized_infinite(spark, sf):
    """Standard scores where some features are infinite or not a number."""
    uf = written_once(user_features_of(spark, sf))
    odd = uf.withColumn("mean_session_duration", F.when(F.col("user_id") % 5 == 0, float("inf"))
                        .when(F.col("user_id") % 7 == 0, float("nan")).when(F.col("user_id") % 11 == 0, float("-inf"))
                        .otherwise(F.col("mean_session_duration")))
    return segments.standardize(odd, ["mean_session_duration", "n_events"])


# ------------------------------------------------------------------ files
def q_loaded(spark, sf, name: str):
    """One of the three tables after the way through CSV files and the loader."""
    data = csv_loader.load_all(spark, text_tables.as_csv_files(spark, sf))
    return sinks.without_helpers(getattr(data, name))


def q_stored_sessions(spark, sf):
    """Sessions written in order, noted, and read by a resumed run, which must not make them again."""
    out = shared_path(spark, "stored")
    sinks.Manifest(spark, out).parquet("sessions", "sessions", lambda: sessions_of(spark, sf), pipeline.SESSION_ORDER)

    def again():
        raise RuntimeError("a noted artifact was made again")

    return sinks.Manifest(spark, out, resume=True).parquet("sessions", "sessions", again, pipeline.SESSION_ORDER)


def q_stored_assignments(spark, sf):
    """Assignments written as ordered CSV files and read back."""
    asg = assignments_of(spark, sf)
    path = sinks.write_ordered(asg, ["user_id"], shared_path(spark, "assignments-csv"), "csv")
    return spark.read.schema(asg.schema).option("header", True).csv(path)


def q_ordered_outputs(spark, sf):
    """Rows of the ordered outputs, read back, and whether they are in order inside and across files."""
    outputs = [("sessions", sessions_of(spark, sf), pipeline.SESSION_ORDER, "parquet"),
               ("journeys", _jout(journeys_of(spark, sf)), pipeline.JOURNEY_ORDER, "csv"),
               ("assignments", assignments_of(spark, sf), ["user_id"], "parquet")]
    reports = []
    for name, df, keys, kind in outputs:
        path = sinks.write_ordered(df, keys, shared_path(spark, f"ordered-{name}"), kind)
        reports.append(sinks.order_report(spark, path, keys, kind, df.schema).select(F.lit(name).alias("output"), "*"))
    return reduce(DataFrame.unionByName, reports)


def queries() -> dict[str, Query]:
    vocab = labels.content_vocabulary(dt.PART_CATEGORY_MAP)
    share_cols = [features.share_column(v) for v in vocab]
    q: dict[str, Query] = {
        "events_dedup": events_clean,
        "items_first": items_first,
        "users_latest": users_latest,
        "country_fill": lambda s, d: events_clean(s, d).groupBy("country").agg(F.count(F.lit(1)).alias("n_events")),
        "dq_summary": lambda s, d: q_dq(s, d, raw=False),
        "dq_summary_raw": lambda s, d: q_dq(s, d, raw=True),
        "dq_nulls": lambda s, d: quality.null_counts(dt.raw_events(s, d)),
        "dq_unknown_items": lambda s, d: quality.check_events(
            events_clean(s, d), items_first(s, d), users_latest(s, d)).details["missing_items"],
        "dq_unknown_users": lambda s, d: quality.check_events(
            events_clean(s, d), items_first(s, d), users_latest(s, d)).details["missing_users"],
        "label_events": events_labeled,
        "content_type_counts": lambda s, d: labels.content_type_counts(events_labeled(s, d)),
        "price_bucket_counts": lambda s, d: labels.price_bucket_counts(events_labeled(s, d)),
        "sessions": sessions_of,
        "session_flags": lambda s, d: sessions_of(s, d).groupBy("has_purchase", "has_add_to_cart").agg(
            F.count(F.lit(1)).alias("n_sessions")),
        "user_session_features": lambda s, d: features.user_session_features(sessions_of(s, d)),
        "user_event_features": lambda s, d: q_user_event(s, d).select("user_id", *features.EVENT_FEATURES),
        "content_shares": lambda s, d: q_user_event(s, d).select("user_id", *share_cols),
        "content_entropy": lambda s, d: q_user_event(s, d).select("user_id", "content_entropy"),
        "user_features": user_features_of,
        "standardized_features": zscores,
        "nearest_centroid": q_nearest,
        "inertia_given_labels": q_inertia,
        "silhouette_given_labels": q_silhouette,
        "outlier_policy": q_outlier,
        "renumber_segments": q_renumber,
        "segment_profile": q_profile,
        "segment_conversion": q_conversion,
        "segment_quadrant": lambda s, d: conversion.quadrant_table(q_conversion(s, d)),
        "segment_leakage_size": lambda s, d: conversion.leakage_size_table(q_conversion(s, d)),
        "journeys_event_type": lambda s, d: _jout(journeys_of(s, d)),
        "journeys_content_type": lambda s, d: _jout(journeys_of(s, d, step_mode="content_type")),
        "journeys_hybrid": lambda s, d: _jout(journeys_of(s, d, step_mode="hybrid")),
        "journeys_keep_repeats": lambda s, d: _jout(journeys_of(s, d, drop_repeats=False)),
        "journeys_truncated": lambda s, d: _jout(journeys_of(s, d, max_steps=3)),
        "transition_counts": lambda s, d: paths.transition_counts(journeys_of(s, d)),
        "transition_counts_content": lambda s, d: paths.transition_counts(journeys_of(s, d, step_mode="content_type")),
        "transition_matrix": q_transition_matrix,
        "transition_matrix_content": lambda s, d: paths.transition_matrix(
            paths.transition_counts(journeys_of(s, d, step_mode="content_type"))),
        "top_paths": lambda s, d: paths.top_paths(written(_path_rows(journeys_of(s, d)), "journeys")),
        "funnel": lambda s, d: paths.funnel(journeys_of(s, d)),
        "segment_path_lift": q_lift,
        "segment_shares_week": q_shares_week,
        "segment_shares_month": q_shares_month,
        "segment_shares_periods": q_shares_of_periods,
        "drift_week": lambda s, d: stability.temporal_drift(q_shares_week(s, d)),
        "drift_month": lambda s, d: stability.temporal_drift(q_shares_month(s, d)),
        "stability_drift_summary": q_drift_summary,
        "ari_given_labels": q_ari,
        "sessions_month": q_m_sessions,
        "user_features_month": q_m_user_features,
        "segment_conversion_month": lambda s, d: conversion.segment_conversion(q_m_sessions(s, d), m_assignments(s, d)),
        "journeys_month": lambda s, d: _jout(q_m_journeys(s, d)),
        "top_paths_month": lambda s, d: paths.top_paths(written(_path_rows(q_m_journeys(s, d)), "journeys")),
        "parsed_events": text_tables.parsed_events,
        "parsed_items": text_tables.parsed_items,
        "parsed_users": text_tables.parsed_users,
        "dq_durations": q_dq_durations,
        "segment_conversion_idle": q_conversion_idle,
        "standardized_infinite": q_standardized_infinite,
        "bootstrap_draws": q_bootstrap_draws,
        "bootstrap_sizes": q_bootstrap_sizes,
        "bootstrap_ari_given_labels": q_bootstrap_ari,
        "lloyd_step": q_lloyd_step,
        "kmeans_invariants": q_kmeans_invariants,
        "kmeans_segments": q_kmeans_segments,
        "k_selection": q_k_selection,
        "bootstrap_stability": q_bootstrap,
        "loaded_events": lambda s, d: q_loaded(s, d, "events"),
        "loaded_items": lambda s, d: q_loaded(s, d, "items"),
        "loaded_users": lambda s, d: q_loaded(s, d, "users"),
        "stored_sessions": q_stored_sessions,
        "stored_assignments_csv": q_stored_assignments,
        "ordered_outputs": q_ordered_outputs,
        "pipeline_run": q_pipeline,
    }
    return {name: (lambda fn: (lambda spark, sf: rounded(fn(spark, sf))))(fn) for name, fn in q.items()}
