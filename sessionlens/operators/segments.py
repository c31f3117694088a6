"""User segmentation: standardisation, k-means, labels, outliers, profiles.

The feature matrix lives in Spark; only model parameters reach the driver:
per-feature mean/deviation (2 x d numbers), centroids (k x d per model), per-cluster
counts (k), per-k metrics and the anchors of the silhouettes.  Label assignment is a projection against the
centroids (argmin of k squared distances), so it stays inside whole-stage
codegen and needs no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from sessionlens.operators.features import SHARE_PREFIX
from sessionlens.functions import finite_or_zero
from sessionlens.functions.quantiles import grouped_median
from sessionlens.operators.kmeans import TIE, Model, best_fits, cached, fit_models, sampled_silhouettes, with_labels
from sessionlens.schema import assert_unique
from sessionlens.session import written

# Base features used for segmentation when present (order kept).
BASE_FEATURES = [
    "n_sessions", "n_events", "active_days", "purchase_rate_sessions", "add_to_cart_rate_sessions",
    "mean_session_duration", "mean_events_per_session", "mean_unique_items_per_session", "content_entropy",
]
# Core columns of the segment profile (order kept).
PROFILE_CORE = [
    "n_sessions", "n_events", "purchase_rate_sessions", "add_to_cart_rate_sessions",
    "mean_session_duration", "active_days", "content_entropy",
]


@dataclass(frozen=True)
class SegmentationResult:
    assignments: DataFrame
    profile: DataFrame
    model_info: DataFrame
    feature_columns: list
    chosen_k: int
    outlier_threshold: float
    centers: list


def feature_columns(df: DataFrame) -> list[str]:
    shares = [c for c in df.columns if c.startswith(SHARE_PREFIX)]
    return [c for c in BASE_FEATURES if c in df.columns] + shares


def profile_columns(features: list[str]) -> list[str]:
    shares = [c for c in features if c.startswith(SHARE_PREFIX)]
    return [c for c in PROFILE_CORE + shares if c in features]


def standardize(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """z = (x - mean) / population std; +-inf/NaN/null -> 0 first; zero std -> scale 1."""
    keep = keep or ["user_id"]
    x = df.select(*keep, *[finite_or_zero(F.col(c)).alias(c) for c in cols])
    stats = x.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        mean = stats[f"m{i}"] if stats[f"m{i}"] is not None else 0.0
        std = stats[f"s{i}"]
        scale = std if std is not None and std > 0 else 1.0
        out.append(((F.col(c) - F.lit(mean)) / F.lit(scale)).alias(c))
    return x.select(*keep, *out)


def squared_distance(cols: list[str], center: list[float]) -> F.Column:
    terms = [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols, center)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def assign_nearest(df: DataFrame, cols: list[str], centers: list[list[float]],
                   label_col: str = "segment_id", dist_col: str | None = None, tie: float = 0.0) -> DataFrame:
    """Label = index of the nearest centre (ties, distances within ``tie`` -> lowest index)."""
    d = F.array(*[squared_distance(cols, c) for c in centers])
    first = F.array_position(F.col("_d"), F.array_min(F.col("_d")))
    if tie:
        first = F.array_position(F.transform("_d", lambda x: x <= F.array_min(F.col("_d")) + F.lit(tie)), True)
    out = df.withColumn("_d", d).withColumn(label_col, (first - 1).cast("int"))
    if dist_col:
        out = out.withColumn(dist_col, F.array_min(F.col("_d")))
    return out.drop("_d")


MAX_LABELS = 10_000


def bounded_rows(per_label: DataFrame, most: int = MAX_LABELS) -> list:
    """The rows of a one-row-per-label table; more than ``most`` labels are refused."""
    rows = per_label.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels; cluster statistics are for a bounded number of clusters")
    return rows


def label_centroids(df: DataFrame, cols: list[str], label_col: str) -> list[tuple[int, list[float]]]:
    """Mean vector per label (at most ``MAX_LABELS`` rows to the driver), sorted by label."""
    rows = bounded_rows(df.groupBy(label_col).agg(*[F.avg(c).alias(f"c{i}") for i, c in enumerate(cols)]))
    return sorted((r[label_col], [r[f"c{i}"] for i in range(len(cols))]) for r in rows)


def inertia(df: DataFrame, cols: list[str], label_col: str, centers: dict) -> DataFrame:
    """One row: sum of squared distances of every point to its own centre."""
    dist = None
    for label, center in centers.items():
        branch = squared_distance(cols, center)
        dist = F.when(F.col(label_col) == label, branch) if dist is None else dist.when(F.col(label_col) == label, branch)
    return df.agg(F.sum(dist).alias("inertia"))


def silhouette_sq_euclidean(df: DataFrame, cols: list[str], label_col: str,
                            weight_col: str | None = None) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, in linear time.

    Same definition as MLlib's ClusteringEvaluator: the mean distance to a
    cluster C is |x|^2 + sum_C|y|^2 / W_C - 2 x . sum_C y / W_C, the own
    cluster is corrected for the point itself, and a point alone in its
    cluster scores 0.  Only per-cluster sums (k x d) reach the driver.
    """
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    sqn = None
    for c in cols:
        sqn = F.col(c) * F.col(c) if sqn is None else sqn + F.col(c) * F.col(c)
    pts = df.select(F.col(label_col).alias("_l"), w.alias("_w"), sqn.alias("_sqn"), *cols)
    stats = bounded_rows(pts.groupBy("_l").agg(
        F.sum("_w").alias("W"), F.sum(F.col("_w") * F.col("_sqn")).alias("Q"),
        *[F.sum(F.col("_w") * F.col(c)).alias(f"S{i}") for i, c in enumerate(cols)],
    ))
    clusters = sorted(stats, key=lambda r: r["_l"])
    if len(clusters) < 2:
        raise ValueError("silhouette needs at least two clusters")

    def mean_dist(r):
        dot = None
        for i, c in enumerate(cols):
            t = F.col(c) * F.lit(float(r[f"S{i}"]))
            dot = t if dot is None else dot + t
        return F.col("_sqn") + F.lit(r["Q"] / r["W"]) - F.lit(2.0) * dot / F.lit(r["W"])

    # the k distances of a point once, as an array; its own cluster by place, the others by their least
    place = F.array_position(F.array(*[F.lit(r["_l"]) for r in clusters]), F.col("_l")).cast("int")
    pts = pts.select("_w", place.alias("_k"), F.array(*[mean_dist(r) for r in clusters]).alias("_d"))
    pts = pts.withColumn("_cw", F.element_at(F.array(*[F.lit(float(r["W"])) for r in clusters]), F.col("_k")))
    own = F.element_at("_d", F.col("_k")) * F.col("_cw") / (F.col("_cw") - F.col("_w"))
    other = F.array_min(F.transform("_d", lambda d, i: F.when(i + 1 != F.col("_k"), d)))
    s = (
        F.when(F.col("_cw") == F.col("_w"), F.lit(0.0))
        .when(F.col("_a") < F.col("_b"), F.lit(1.0) - F.col("_a") / F.col("_b"))
        .when(F.col("_a") > F.col("_b"), F.col("_b") / F.col("_a") - F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    per_point = pts.select("_w", "_cw", own.alias("_a"), other.alias("_b")).select(
        "_w", s.alias("_s")
    )
    return per_point.agg((F.sum(F.col("_s") * F.col("_w")) / F.sum("_w")).alias("silhouette"))


def points_of(scaled: DataFrame, cols: list[str], id_col: str, keep: list[str] | None = None) -> DataFrame:
    """The rows as points for ``operators.kmeans``: id, x (the features in order) and the columns to keep."""
    return scaled.select(F.col(id_col).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), *(keep or []))


def outlier_policy(labels: DataFrame, threshold: float, label_col: str = "segment_id") -> DataFrame:
    """Clusters holding less than ``threshold`` of the users become -1 (0 = off).

    The per-cluster share table has one row per cluster; the tiny clusters are
    joined back (one row per label).
    """
    if not threshold or threshold <= 0:
        return labels
    shares = labels.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_share", F.col("_n") / F.sum("_n").over(Window.partitionBy())
    )
    tiny = shares.where(F.col("_share") < threshold).select(F.col(label_col).alias("_tiny"))
    out = labels.join(tiny, labels[label_col] == tiny["_tiny"], "left")
    return out.withColumn(label_col, F.when(F.col("_tiny").isNotNull(), F.lit(-1)).otherwise(F.col(label_col)).cast("int")).drop("_tiny")


def renumber(assignments: DataFrame, label_col: str = "segment_id") -> DataFrame:
    """Map the non-negative ids to 0..n-1 in sorted order; -1 stays -1."""
    ids = assignments.where(F.col(label_col) >= 0).select(F.col(label_col).alias("_old")).distinct()
    mapping = ids.withColumn("_new", (F.dense_rank().over(Window.orderBy("_old")) - 1).cast("int"))
    out = assignments.join(mapping, assignments[label_col] == mapping["_old"], "left")
    return out.withColumn(label_col, F.coalesce(F.col("_new"), F.lit(-1)).cast("int")).drop("_old", "_new")


def segment_profile(user_features: DataFrame, assignments: DataFrame, features: list[str],
                    id_col: str = "user_id", label_col: str = "segment_id", median: str = "exact") -> DataFrame:
    """Per segment (>= 0): n_users, then <f>_mean and <f>_median of the profile columns.

    ``median="exact"`` (default) is the interpolated median with bounded task
    memory (two grouped passes); ``median="approx"`` is one pass with
    ``percentile_approx`` (a data value within 1/10000 of the middle rank).
    """
    cols = profile_columns(features)
    asg = assert_unique(assignments.select(id_col, F.col(label_col).cast("int").alias(label_col)), [id_col],
                        "assignments")
    j = user_features.join(asg, id_col, "inner").where(F.col(label_col) >= 0)
    extra = [F.count(F.lit(1)).alias("n_users")] + [F.avg(c).alias(f"{c}_mean") for c in cols]
    if median == "approx":
        out = j.groupBy(label_col).agg(*extra, *[F.percentile_approx(F.col(c).cast("double"), 0.5, 10000)
                                                 .alias(f"{c}_median") for c in cols])
    elif median == "exact":
        # means and n_users ride along in the median's first grouped pass
        out = grouped_median(j, [label_col], cols, suffix="_median", extra_aggs=extra)
    else:
        raise ValueError("median must be 'exact' or 'approx'")
    ordered = ["n_users"]
    for c in cols:
        ordered += [f"{c}_mean", f"{c}_median"]
    return out.select(label_col, *ordered).orderBy(label_col)


def segment_users(
    user_features: DataFrame,
    features: list[str] | None = None,
    id_col: str = "user_id",
    min_sessions: int = 1,
    renumber_segments: bool = True,
    k_range=range(3, 9),
    seed: int = 42,
    max_iter: int = 300,
    n_init: int = 20,
    outlier_threshold: float = 0.0,
    anchors_per_cluster: int = 128,
) -> SegmentationResult:
    """Segments of the users with at least ``min_sessions`` sessions; the others are -1.

    Every k of ``k_range`` is fitted from ``n_init`` seeds (all in the same passes over
    the users, see ``operators.kmeans``) and keeps its fit of least cost.  The k of
    the largest Euclidean silhouette is chosen (equal ones: the smallest k); each
    k's silhouette is over ``anchors_per_cluster`` points of each cluster against all
    users, with its standard error in ``model_info``.
    """
    spark = user_features.sparkSession
    features = features or feature_columns(user_features)
    ks = [int(k) for k in k_range]
    eligible = user_features.where(F.col("n_sessions") >= min_sessions)
    ineligible = user_features.where(F.col("n_sessions") < min_sessions)
    scaled = written(standardize(eligible, features, keep=[id_col]), "scaled-users")
    points = cached(points_of(scaled, features, id_col))
    models = [Model(k, sd) for k in ks for sd in range(seed, seed + n_init)]
    best = best_fits(fit_models(points, models, max_iter), lambda m: m.k)
    silhouettes = sampled_silhouettes(with_labels(points, [best[k] for k in ks]), len(ks), None, anchors_per_cluster, seed)
    points.unpersist()
    rows = [(k, sil, best[k].cost, error) for k, (sil, error) in zip(ks, silhouettes)]
    model_info = spark.createDataFrame(rows, "k int, silhouette double, inertia double, silhouette_error double").orderBy("k")
    chosen_k = min(rows, key=lambda r: (math.isnan(r[1]), -r[1], r[0]))[0]
    centers = [list(map(float, c)) for c in best[chosen_k].centres]
    labels = assign_nearest(scaled, features, centers, tie=TIE).select(id_col, "segment_id")
    labels = outlier_policy(labels, outlier_threshold)
    rest = ineligible.select(id_col, F.lit(-1).cast("int").alias("segment_id"))
    assignments = labels.unionByName(rest)
    if renumber_segments:
        assignments = renumber(assignments)
    profile = segment_profile(user_features, assignments, features, id_col)
    return SegmentationResult(
        assignments=assignments,  # one row per user: sort only where a small extract is written
        profile=profile,
        model_info=model_info,
        feature_columns=features,
        chosen_k=chosen_k,
        outlier_threshold=float(outlier_threshold),
        centers=centers,
    )
