"""Bootstrap stability of a segmentation: refit k-means on resamples, compare by ARI.

A sample is exactly ``floor(frac * N)`` draws with replacement: draw ``j`` of a run
takes the user of number ``floor(u * N)``, with ``u`` from the MD5 of "run:j:seed", so
any engine, partitioning or retry draws the same.  Draws are counted per user
(every run a place of one array) and weigh the users in the fits: all runs and
seeds are fitted in the same passes over the users (``operators.kmeans``).
Agreement with the baseline labels is a weighted contingency table per run: each
drawn copy counts once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.hashing import hash_uniform
from sessionlens.functions.numbering import numbered
from sessionlens.operators.kmeans import Model, best_fits, cached, fit_models, sampled_silhouettes, with_labels
from sessionlens.operators.segments import points_of, standardize
from sessionlens.operators.stability import adjusted_rand_index
from sessionlens.schema import assert_unique
from sessionlens.session import remove_written, written

#: Points of each cluster that stand for it in a run's silhouette.
ANCHORS_PER_CLUSTER = 64


def exact_draws(n_rows: int, runs: int, sample_frac: float, seed: int, spark) -> DataFrame:
    """``row`` and ``w``: how often each row number below ``n_rows`` is drawn in each run (rows of no draw are left out)."""
    n = math.floor(sample_frac * n_rows)
    if n < 1:
        raise ValueError(f"a share of {sample_frac} of {n_rows} users is no user")
    draws = spark.range(runs * n).select(F.expr(f"id div {n}").alias("run0"), (F.col("id") % n).alias("j"))
    u = hash_uniform(F.col("run0") + 1, F.col("j"), F.lit(seed))
    row = F.least(F.floor(u * F.lit(float(n_rows))), F.lit(n_rows - 1)).cast("long")
    counts = [F.count_if(F.col("run0") == r).cast("int") for r in range(runs)]
    return draws.select("run0", row.alias("row")).groupBy("row").agg(F.array(*counts).alias("w"))


def drawn_users(users: DataFrame, runs: int, sample_frac: float, seed: int, id_col: str = "user_id") -> DataFrame:
    """``users`` (one row each) with ``w``, the draws of each run; users who are never drawn are left out."""
    rows, n = numbered(users, [id_col])
    return rows.join(exact_draws(n, runs, sample_frac, seed, users.sparkSession), "row").drop("row")


def bootstrap_stability(
    user_features: DataFrame,
    assignments: DataFrame,
    features: list[str],
    chosen_k: int,
    runs: int = 20,
    sample_frac: float = 0.8,
    seed: int = 42,
    n_init: int = 20,
    max_iter: int = 300,
    id_col: str = "user_id",
) -> DataFrame:
    """Rows (run, ari_vs_baseline, silhouette, silhouette_error), one per bootstrap run.

    Users with a baseline label (including -1) are standardised once on the
    whole population; every run refits k-means from the seeds ``seed + run`` on, the
    best of ``n_init``.  The silhouette is Euclidean, over anchors of each cluster,
    with its standard error; a run with one cluster has none (not a number).
    """
    spark = user_features.sparkSession
    labels = assignments.select(id_col, F.col("segment_id").cast("int").alias("segment_id"))
    base = user_features.join(assert_unique(labels, [id_col], "assignments"), id_col, "inner").where(F.col("segment_id").isNotNull())
    scaled = standardize(written(base.select(id_col, "segment_id", *features), "bootstrap-users"), features, keep=[id_col, "segment_id"])
    drawn = drawn_users(points_of(scaled, features, id_col, ["segment_id"]), runs, sample_frac, seed, "id")
    stored = written(drawn, "bootstrap-points")
    points = cached(stored)
    models = [Model(chosen_k, seed + run + i, run - 1) for run in range(1, runs + 1) for i in range(n_init)]
    best = best_fits(fit_models(points, models, max_iter), lambda m: m.weight)
    labelled = cached(with_labels(points, [best[r] for r in range(runs)]))
    pairs = labelled.select("segment_id", "w", F.posexplode("labels").alias("run0", "prediction"))
    pairs = pairs.select((F.col("run0") + 1).alias("run"), "segment_id", "prediction", F.get("w", F.col("run0")).alias("n")).where("n > 0")
    ari = {r.run: r.ari for r in adjusted_rand_index(pairs, "segment_id", "prediction", "n", ["run"]).collect()}  # one row per run
    silhouettes = sampled_silhouettes(labelled, runs, list(range(runs)), ANCHORS_PER_CLUSTER, seed)
    labelled.unpersist()
    points.unpersist()
    remove_written(stored)
    rows = [(run, float(ari[run]), *silhouettes[run - 1]) for run in range(1, runs + 1)]
    return spark.createDataFrame(rows, "run int, ari_vs_baseline double, silhouette double, silhouette_error double")
