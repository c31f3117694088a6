"""Segmentation, agreement and quantile invariants."""

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sessionlens.functions.quantiles import grouped_median
from sessionlens.operators import bootstrap, kmeans, segments, stability


def _labels(spark, a, b):
    return spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))], "id long, t int, p int")


def test_ari_values(spark):
    a, b = [0, 0, 1, 1, 2, 2], [1, 1, 0, 0, 0, 2]
    assert stability.adjusted_rand_index(_labels(spark, a, b), "t", "p").first()["ari"] == pytest.approx(0.44444444, abs=1e-8)
    assert stability.adjusted_rand_index(_labels(spark, a, a), "t", "p").first()["ari"] == 1.0
    perm = [{0: 2, 1: 0, 2: 1}[x] for x in b]
    assert stability.adjusted_rand_index(_labels(spark, a, perm), "t", "p").first()["ari"] == pytest.approx(0.44444444, abs=1e-8)
    # weights count rows several times: same as repeating them
    w = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 1, 3.0)], "t int, p int, w double")
    rep = _labels(spark, [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 1, 1])
    assert stability.adjusted_rand_index(w, "t", "p", "w").first()["ari"] == pytest.approx(
        stability.adjusted_rand_index(rep, "t", "p").first()["ari"])


def _blobs(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    centers = np.array([[0.0, 0.0], [10.0, 10.0], [0.0, 12.0]])
    rows, truth = [], []
    for i in range(n):
        c = i % 3
        x = centers[c] + rng.normal(0, 0.5, 2)
        rows.append((i, float(x[0]), float(x[1]), c))
    return spark.createDataFrame(rows, "user_id long, f1 double, f2 double, truth int")


def _brute_sq_silhouette(X, lab):
    d = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_matches_mllib_and_brute_force(spark):
    df = _blobs(spark)
    rng = np.random.default_rng(3)
    noisy = df.withColumn("lab", F.when(F.rand(7) < 0.2, F.lit(0)).otherwise(F.col("truth")))
    pdf = noisy.toPandas()
    ours = segments.silhouette_sq_euclidean(noisy, ["f1", "f2"], "lab").first()["silhouette"]
    vec = VectorAssembler(inputCols=["f1", "f2"], outputCol="features").transform(noisy.withColumn("prediction", F.col("lab").cast("double")))
    mllib = ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(vec)
    brute = _brute_sq_silhouette(pdf[["f1", "f2"]].to_numpy(), pdf["lab"].to_numpy())
    assert ours == pytest.approx(mllib, abs=1e-9)
    assert ours == pytest.approx(brute, abs=1e-9)
    assert rng is not None


def test_kmeans_recovers_blobs_and_invariants(spark):
    df = _blobs(spark).withColumn("n_sessions", F.lit(1))
    res = segments.segment_users(df, ["f1", "f2"], k_range=range(2, 5), n_init=2, max_iter=50)
    assert res.chosen_k == 3
    lab = res.assignments.join(df.select("user_id", "truth"), "user_id")
    assert stability.adjusted_rand_index(lab, "truth", "segment_id").first()["ari"] == 1.0
    ids = sorted(r[0] for r in res.assignments.select("segment_id").distinct().collect())
    assert ids == [0, 1, 2]
    assert res.assignments.count() == 60
    info = {r["k"]: r for r in res.model_info.collect()}
    assert max(info, key=lambda k: (info[k]["silhouette"], -k)) == 3
    assert all(-1 <= r["silhouette"] <= 1 for r in info.values())
    prof = res.profile.collect()
    assert sum(r["n_users"] for r in prof) == 60


def test_inertia_equals_recomputed(spark):
    df = _blobs(spark)
    cents = dict(segments.label_centroids(df, ["f1", "f2"], "truth"))
    got = segments.inertia(df, ["f1", "f2"], "truth", cents).first()["inertia"]
    pdf = df.toPandas()
    want = sum(((pdf.loc[pdf.truth == c, ["f1", "f2"]] - pdf.loc[pdf.truth == c, ["f1", "f2"]].mean()) ** 2).to_numpy().sum()
               for c in range(3))
    assert got == pytest.approx(want)


def test_outlier_policy_and_renumber(spark):
    lab = spark.createDataFrame([(i, 0 if i < 8 else (3 if i < 10 else 5)) for i in range(11)], "user_id long, segment_id int")
    out = {r["user_id"]: r["segment_id"] for r in segments.renumber(segments.outlier_policy(lab, 0.15)).collect()}
    assert out[0] == 0 and out[8] == 1 and out[10] == -1  # 3 -> 1 after renumbering; 5 (1/11 < .15) -> -1


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, float("inf"), 5.0)], "user_id long, a double, b double")
    z = {r["user_id"]: (r["a"], r["b"]) for r in segments.standardize(df, ["a", "b"]).collect()}
    x = np.array([1.0, 3.0, 0.0])
    want = (x - x.mean()) / x.std()
    assert [z[i][0] for i in (1, 2, 3)] == pytest.approx(list(want))
    assert all(z[i][1] == 0.0 for i in (1, 2, 3))  # zero variance -> 0


@pytest.mark.parametrize("accuracy", [50, 10000])
def test_grouped_median_exact(spark, accuracy):
    rng = np.random.default_rng(5)
    rows = []
    for g, n in ((0, 1), (1, 2), (2, 7), (3, 4000), (4, 3001)):
        vals = rng.integers(0, 40, n) if g == 3 else rng.normal(0, 1, n)
        rows += [(g, float(v), float(v) * 2 if i % 5 else None) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r["g"]: r for r in grouped_median(df, ["g"], ["x", "y"], accuracy=accuracy).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        assert got[g]["x_median"] == pytest.approx(part["x"].median())
        if part["y"].notna().any():
            assert got[g]["y_median"] == pytest.approx(part["y"].median())


@pytest.mark.parametrize("n, frac", [(1, 1.0), (7, 0.8), (500, 0.8), (40, 2.5)])
def test_draws_are_exact_and_the_same_under_any_partitioning(spark, n, frac):
    users = spark.range(n).select((F.col("id") * 3 + 5).alias("user_id"))
    got = sorted(tuple(r) for r in bootstrap.drawn_users(users, 6, frac, 42).collect())
    assert got == sorted(tuple(r) for r in bootstrap.drawn_users(users.repartition(7), 6, frac, 42).collect())
    draws = np.array([w for _, w in got])
    assert draws.sum(0).tolist() == [int(frac * n)] * 6
    want = np.zeros((n, 6), int)  # draw by draw
    for run in range(6):
        for j in range(int(frac * n)):
            u = int(hashlib.md5(f"{run + 1}:{j}:42".encode()).hexdigest()[:13], 16) / 16**13
            want[min(int(u * n), n - 1), run] += 1
    assert {u: tuple(w) for u, w in got} == {3 * k + 5: tuple(w) for k, w in enumerate(want.tolist()) if any(w)}


def test_no_draws_are_refused(spark):
    with pytest.raises(ValueError):
        bootstrap.exact_draws(10, 3, 0.05, 42, spark)


def test_bootstrap_on_blobs(spark):
    df = _blobs(spark, n=90).withColumn("n_sessions", F.lit(1))
    asg = df.select("user_id", F.col("truth").alias("segment_id"))
    out = bootstrap.bootstrap_stability(df, asg, ["f1", "f2"], 3, runs=3, n_init=2, max_iter=50).collect()
    assert [r["run"] for r in out] == [1, 2, 3]
    assert all(r["ari_vs_baseline"] == pytest.approx(1.0) for r in out)
    assert all(0.5 < r["silhouette"] <= 1 for r in out)


def test_activity_filter_outliers_and_profile(spark):
    df = _blobs(spark, n=60).withColumn("n_sessions", F.when(F.col("user_id") < 6, F.lit(1)).otherwise(F.lit(3)))
    res = segments.segment_users(df, ["f1", "f2", "n_sessions"], min_sessions=2, k_range=range(3, 4), n_init=2,
                                 max_iter=50, outlier_threshold=0.0)
    asg = {r["user_id"]: r["segment_id"] for r in res.assignments.collect()}
    assert all(asg[u] == -1 for u in range(6))
    assert all(asg[u] >= 0 for u in range(6, 60))
    prof = res.profile.collect()
    assert sum(r["n_users"] for r in prof) == 54  # -1 excluded from the profile
    assert "n_sessions_median" in res.profile.columns and "n_sessions_mean" in res.profile.columns
    approx = segments.segment_profile(df, res.assignments, ["f1", "f2", "n_sessions"], median="approx").collect()
    assert [r["n_sessions_median"] for r in approx] == [r["n_sessions_median"] for r in prof]
    # a cluster under the outlier threshold is relabelled -1 and the rest renumbered
    res2 = segments.segment_users(df, ["f1", "f2", "n_sessions"], min_sessions=1, k_range=range(4, 5), n_init=2,
                                  max_iter=50, outlier_threshold=0.2)
    ids = sorted({r["segment_id"] for r in res2.assignments.collect()})
    assert ids[0] == -1 or len(ids) <= 4
    assert ids[-1] == len([i for i in ids if i >= 0]) - 1


# ------------------------------------------------- many models in one pass
def _points(spark, x, w=None, parts=3):
    rows = [(i * 7 % 1009, p.tolist(), *(() if w is None else (w[i].tolist(),))) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>" + ("" if w is None else ", w array<int>")).repartition(parts)


def _start_by_hand(x, ids, w, seed, k):
    chosen = []
    for step in range(k):
        best = None
        for p in range(len(x)):
            if w[p] <= 0:
                continue
            d2 = min((((x[p] - x[c]) ** 2).sum() for c in chosen), default=1.0)
            u = max(int(hashlib.md5(f"{ids[p]}:{seed}:{step}".encode()).hexdigest()[:13], 16) / 16**13, 2.0**-53)
            race = -math.log(u) / (w[p] * d2) if d2 >= 1e-12 else 1e300
            best = min(best or (race, ids[p], p), (race, ids[p], p))
        chosen.append(best[2])
    return x[chosen]


def _lloyd_by_hand(x, w, centres, max_iter=300, tol=1e-4):
    steps = 0
    while steps < max_iter:
        d2 = ((x[:, None] - centres) ** 2).sum(2)
        lab = (d2 <= d2.min(1)[:, None] + 1e-9).argmax(1)
        new = np.array([np.average(x[lab == c], axis=0, weights=w[lab == c]) if w[lab == c].sum() > 0 else centres[c] for c in range(len(centres))])
        moved, centres, steps = ((new - centres) ** 2).sum(), new, steps + 1
        if moved <= tol:
            break
    d2 = ((x[:, None] - centres) ** 2).sum(2)
    return centres, steps, (w * d2.min(1)).sum()


def test_models_fitted_together_equal_each_fitted_by_hand(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(150, 3)), 1)  # coarse: repeated points and points half-way between centres
    w = rng.integers(0, 3, (150, 2)).astype(np.int32)
    points = kmeans.cached(_points(spark, x, w))
    ids = [i * 7 % 1009 for i in range(150)]
    models = [kmeans.Model(k, s, p) for k in (2, 3, 5) for s in (1, 2) for p in (-1, 0, 1)]
    for fit in kmeans.fit_models(points, models):
        own = np.ones(150) if fit.model.weight < 0 else w[:, fit.model.weight].astype(float)
        start = _start_by_hand(x, ids, own, fit.model.seed, fit.model.k)
        centres, steps, cost = _lloyd_by_hand(x, own, start)
        assert np.allclose(fit.centres, centres, atol=1e-9) and fit.steps == steps and fit.cost == pytest.approx(cost)


def test_models_with_fewer_points_than_clusters(spark):
    same = _points(spark, np.array([[1.0, 2.0]] * 5 + [[3.0, 4.0]]))
    fit = kmeans.fit_models(same, [kmeans.Model(4, 1)])[0]
    assert fit.cost == 0 and {tuple(c) for c in fit.centres.tolist()} == {(1.0, 2.0), (3.0, 4.0)}
    with pytest.raises(ValueError):
        kmeans.fit_models(_points(spark, np.ones((3, 2)), np.zeros((3, 1), np.int32)), [kmeans.Model(2, 1, 0)])
    with pytest.raises(ValueError):
        kmeans.fit_models(same, [kmeans.Model(kmeans.MAX_CENTRES + 1, 1)])


def _euclidean_silhouette(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        b = min(d[i, lab == c].mean() for c in set(lab.tolist()) - {lab[i]})
        a = d[i, own].sum() / (own.sum() - 1) if own.sum() > 1 else None
        out.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return np.array(out)


def test_silhouettes_of_all_points_are_the_definition(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, (60, 2)), rng.normal(4, 1, (50, 2)), [[40.0, 40.0]]]
    fits = [kmeans.Fitted(kmeans.Model(k, 0), c, 0, 0.0) for k, c in ((2, np.array([[0.0, 0], [4, 4]])), (3, np.array([[0.0, 0], [4, 4], [40, 40]])))]
    labelled = kmeans.with_labels(_points(spark, x), fits)
    got = kmeans.sampled_silhouettes(labelled, 2, per_cluster=1000)
    for (value, error), fit in zip(got, fits, strict=True):
        lab = kmeans.nearest(x, fit.centres[None])[0][:, 0]
        assert value == pytest.approx(_euclidean_silhouette(x, lab).mean()) and error == 0


def test_drawn_copies_count_as_points_of_a_silhouette(spark):
    rng = np.random.default_rng(6)
    x, w = np.r_[rng.normal(0, 1, (20, 2)), rng.normal(3, 1, (15, 2))], rng.integers(0, 4, (35, 1)).astype(np.int32)
    fit = kmeans.Fitted(kmeans.Model(2, 0, 0), np.array([[0.0, 0], [3, 3]]), 0, 0.0)
    value, error = kmeans.sampled_silhouettes(kmeans.with_labels(_points(spark, x, w), [fit]), 1, [0], per_cluster=1000)[0]
    copies = np.repeat(x, w[:, 0], axis=0)
    lab = kmeans.nearest(copies, fit.centres[None])[0][:, 0]
    assert value == pytest.approx(_euclidean_silhouette(copies, lab).mean()) and error == 0


def test_sampled_silhouettes_stay_within_their_error(spark):
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(0, 1, (700, 2)), rng.normal(3, 1, (900, 2))]
    fit = kmeans.Fitted(kmeans.Model(2, 0), np.array([[0.0, 0], [3, 3]]), 0, 0.0)
    labelled = kmeans.cached(kmeans.with_labels(_points(spark, x), [fit]))
    want = _euclidean_silhouette(x, kmeans.nearest(x, fit.centres[None])[0][:, 0]).mean()
    for seed in range(5):
        value, error = kmeans.sampled_silhouettes(labelled, 1, per_cluster=100, seed=seed)[0]
        assert 0 < error < 0.03 and abs(value - want) < 4 * error
    one = kmeans.Fitted(kmeans.Model(1, 0), np.array([[0.0, 0]]), 0, 0.0)
    assert all(math.isnan(v) for v in kmeans.sampled_silhouettes(kmeans.with_labels(_points(spark, x[:9]), [one]), 1)[0])


def test_nearest_is_the_definition_and_faster_than_over_the_last_axis():
    """Labels and distances of points by 200 models, ties among them; no search along an axis of k numbers."""

    def plain(x, centres):
        d2 = (x * x).sum(1)[:, None] - 2.0 * (x @ centres.reshape(-1, x.shape[1]).T) + (centres.reshape(-1, x.shape[1]) ** 2).sum(1)
        d2 = np.maximum(d2, 0.0).reshape(len(x), *centres.shape[:2])
        labels = (d2 <= d2.min(2, keepdims=True) + kmeans.TIE).argmax(2)
        return labels, np.take_along_axis(d2, labels[:, :, None], 2)[:, :, 0]

    rng = np.random.default_rng(2)
    for k in (1, 2, 5):
        centres = rng.normal(size=(200, k, 12))
        x = np.r_[rng.normal(size=(300, 12)), centres[:9, 0], (centres[:9, 0] + centres[:9, -1]) / 2]
        (a, b), (c, d) = kmeans.nearest(x, centres), plain(x, centres)
        assert (a == c).all()
        np.testing.assert_allclose(b, d, atol=1e-12)

    def seconds(of):
        began = time.perf_counter()
        of(x, centres)
        return time.perf_counter() - began

    assert min(seconds(kmeans.nearest) for _ in range(20)) < 0.7 * min(seconds(plain) for _ in range(20))
