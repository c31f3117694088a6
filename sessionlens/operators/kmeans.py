"""K-means for many models at once: every pass over the points serves all of them.

A model is a number of clusters, a seed and, for resamples, a column of draw
counts.  Starts (k-means++) and Lloyd steps of all models are made together: one
pass computes for every model the per-cluster sums of its points, adds them up
per task in numpy (two matrix products for a slice of points) and then per cluster
in a grouped aggregate.  The driver holds centres (models x k x d numbers), never
points; models that have converged drop out of later passes, so a fit takes as
many passes as its slowest model takes steps.

Everything is a function of the points alone: k-means++ draws a point with
probability proportional to weight times squared distance by an exponential race,
the least ``-ln(u) / (w D^2)``, with ``u`` from the MD5 of (id, seed, step).  So any
partitioning, a retried task, or SQL picks the same points.  The starts of a seed
are nested: those for k clusters are the first k of the longest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from sessionlens.functions.hashing import hash_uniform

#: Numbers of the largest matrix that a task holds (slice of points x centres): it stays in a core's cache.
MATRIX = 1 << 18
#: Squared distances below this are zero: the point is one of the centres.
SAME_POINT = 1e-12
#: Squared distances to two centres that differ by no more than this are equal.
TIE = 1e-9
#: Race time of a point that is a centre already: drawn only when nothing else is left.
LAST = 1e300
#: Up to so many rows of tasks' sums go to the driver as they are; more are added up per centre in a shuffle first.
COLLECTED = 50_000
#: More centres (models x k) than this are refused: they and their sums are held by the driver and every task.
MAX_CENTRES = 100_000


@dataclass(frozen=True)
class Model:
    k: int
    seed: int
    weight: int = -1  # the place of its draw counts in the column ``w``; -1: every point counts once


@dataclass
class Fitted:
    model: Model
    centres: np.ndarray
    steps: int
    cost: float


def columns_of(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[dict[str, np.ndarray]]:
    """The columns of slices of rows as numpy arrays; ``wide`` is how many numbers a row takes in the largest matrix."""
    rows = max(64, MATRIX // max(1, wide))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part, out = batch.slice(start, rows), {}
            for name, column in zip(part.schema.names, part.columns, strict=True):
                flat = column.flatten() if pa.types.is_list(column.type) else column
                values = flat.to_numpy(zero_copy_only=False)
                out[name] = values.reshape(part.num_rows, -1) if pa.types.is_list(column.type) else values
            yield out


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For points (n, d) and centres (models, k, d): the nearest cluster and its squared distance, (n, models) each.

    Distances that differ by no more than ``TIE`` are equal and the lower cluster is taken,
    so that points half-way between centres do not depend on the order of additions.
    """
    k, norms = centres.shape[1], (centres * centres).sum(2)
    away = [x @ (-2.0 * centres[:, j]).T for j in range(k)]  # one matrix (n, models) for each cluster, without its norms yet
    own = (x * x).sum(1)[:, None]
    for j, a in enumerate(away):
        a += own
        a += norms[:, j]
    least = away[0].copy()
    for a in away[1:]:
        np.minimum(least, a, out=least)
    limit = np.maximum(least, 0.0, out=least)
    limit += TIE
    labels, d2 = np.full(limit.shape, k - 1), away[-1].copy()
    for j in range(k - 2, -1, -1):
        tied = away[j] <= limit
        np.copyto(labels, j, where=tied)
        np.copyto(d2, away[j], where=tied)
    return labels, np.maximum(d2, 0.0, out=d2)


def weights_of(part: dict[str, np.ndarray], models: list[Model]) -> np.ndarray:
    """How often each point counts for each model, (n, models)."""
    places = np.array([model.weight for model in models])
    if (places < 0).all():
        return np.ones((len(part["x"]), len(models)))
    return np.where(places >= 0, part["w"][:, np.maximum(places, 0)], 1.0)


def same_k(models: list[Model]) -> list[tuple[int, list[int]]]:
    """(k, places of the models with that k)."""
    return [(k, [p for p, m in enumerate(models) if m.k == k]) for k in sorted({m.k for m in models})]


# ----------------------------------------------------------------- starts
def draw_starts(points: DataFrame, chains: list[tuple[int, int]], k: int) -> np.ndarray:
    """k-means++ starts of each chain (seed, place of its weights): (chains, k, d) from ``k`` passes."""
    spark, seeds = points.sparkSession, sorted({s for s, _ in chains})
    place = {s: p for p, s in enumerate(seeds)}
    models = [Model(1, s, w) for s, w in chains]
    first = points.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no points to start from")
    d, n_parts = first.d, points.rdd.getNumPartitions()
    centres = np.empty((len(chains), 0, d))
    for step in range(k):
        u = F.transform(F.lit(seeds), lambda s: hash_uniform(F.col("id"), s, F.lit(step))).alias("u")  # noqa: B023
        sent = spark.sparkContext.broadcast(centres)

        def run(batches, sent=sent, step=step):
            best: dict[int, tuple] = {}
            chosen = sent.value
            for part in columns_of(batches, len(chains) * max(1, step)):
                far = counts = weights_of(part, models)
                away = np.ones(far.shape, bool)
                if step:
                    _, d2 = nearest(part["x"], chosen)
                    away = d2 >= SAME_POINT
                    far = far * np.where(away, d2, 1.0)
                late = -np.log(np.maximum(part["u"], 2.0**-53))[:, [place[s] for s, _ in chains]]
                with np.errstate(divide="ignore"):
                    race = np.where(away, late / far, LAST)
                race[counts <= 0] = np.inf
                least = race.min(0)
                for c in np.flatnonzero(np.isfinite(least)).tolist():
                    ties = np.flatnonzero(race[:, c] == least[c])
                    own = ties[part["id"][ties].argmin()]
                    found = float(least[c]), int(part["id"][own]), part["x"][own].tolist()
                    best[c] = min(best.get(c, found), found)
            if best:
                names = ["chain", "race", "id", "x"]
                types = [pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
                rows = list(zip(*[(c, *b) for c, b in best.items()], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=names)

        drawn = points.select("id", "x", *[c for c in ("w",) if c in points.columns], u).mapInArrow(run, "chain int, race double, id long, x array<double>")
        drawn = drawn.select("chain", F.struct("race", "id", "x").alias("b"))
        if n_parts * len(chains) > COLLECTED:
            drawn = drawn.groupBy("chain").agg(F.min("b").alias("b"))
        got = {r.chain: r.b.x for r in sorted(drawn.collect(), key=lambda r: tuple(r.b), reverse=True)}  # the least of each chain
        sent.destroy()
        if len(got) < len(chains):
            raise ValueError("a model has no points to start from")
        centres = np.concatenate([centres, np.array([got[c] for c in range(len(chains))])[:, None, :]], 1)
    return centres


# ----------------------------------------------------------------- Lloyd
def cluster_sums(points: DataFrame, models: list[Model], centres: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """One pass: per model the weights (k) and sums (k, d) of the points of each of its clusters, and its cost."""
    d = centres[0].shape[1]
    starts = np.cumsum([0, *[m.k for m in models]])
    groups = [(k, own, np.stack([centres[p] for p in own])) for k, own in same_k(models)]
    sent = points.sparkSession.sparkContext.broadcast(groups)
    names = ["slot", "n", "cost", *[f"s{j}" for j in range(d)]]

    def run(batches):
        total = np.zeros((int(starts[-1]), d + 2))
        for part in columns_of(batches, int(starts[-1])):
            x = part["x"]
            for k, own, mine in sent.value:
                labels, d2 = nearest(x, mine)
                w = weights_of(part, [models[p] for p in own])
                at = starts[own]
                total[at, 1] += (w * d2).sum(0)  # the cost of a model stands with its first cluster
                for j in range(k):
                    member = w * (labels == j)
                    total[at + j, 0] += member.sum(0)
                    total[at + j, 2:] += member.T @ x
        held = np.flatnonzero(total.any(1))
        arrays = [pa.array(held, pa.int32()), *[pa.array(c) for c in total[held].T]]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "slot int, " + ", ".join(f"{n} double" for n in names[1:])
    partial = points.select("x", *[c for c in ("w",) if c in points.columns]).mapInArrow(run, schema)
    if points.rdd.getNumPartitions() * int(starts[-1]) > COLLECTED:
        partial = partial.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names[1:]])
    total = np.zeros((int(starts[-1]), d + 2))
    got = partial.toArrow()  # one row per centre, or few tasks' rows of each
    np.add.at(total, got.column("slot").to_numpy(), np.column_stack([got.column(n).to_numpy() for n in names[1:]]))
    sent.destroy()
    cut = [total[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return [c[:, 0] for c in cut], [c[:, 2:] for c in cut], [float(c[0, 1]) for c in cut]


def fit_models(points: DataFrame, models: list[Model], max_iter: int = 300, tol: float = 1e-4, starts: list[np.ndarray] | None = None) -> list[Fitted]:
    """Fit all the models to ``points`` (id long, x array<double>, w array of draw counts where models have weights).

    Lloyd's algorithm from k-means++ starts (or the given ones): a step moves each
    centre to the mean of the points nearest to it (ties: the lower cluster, see ``nearest``; a
    cluster without points keeps its centre) and the fit ends when the squared
    moves of a model's centres add up to at most ``tol``, or after ``max_iter``
    steps.  ``cost`` is the sum of squared distances to the final centres.

    ``points`` must be cheap to read again (written or cached): it is read once per
    step.  Raises where it is empty, or where a model's weights are all zero.
    """
    if sum(m.k for m in models) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres at once")
    if starts is None:
        chains = sorted({(m.seed, m.weight) for m in models})
        drawn = dict(zip(chains, draw_starts(points, chains, max(m.k for m in models)), strict=True))
        starts = [drawn[m.seed, m.weight][: m.k] for m in models]
    centres, steps = [np.array(s, float) for s in starts], [0] * len(models)
    moving = list(range(len(models)))
    for _ in range(max_iter):
        if not moving:
            break
        n, sums, _ = cluster_sums(points, [models[p] for p in moving], [centres[p] for p in moving])
        left = []
        for p, own_n, own_sums in zip(moving, n, sums, strict=True):
            new = np.where(own_n[:, None] > 0, own_sums / np.maximum(own_n, 1e-300)[:, None], centres[p])
            if ((new - centres[p]) ** 2).sum() > tol:
                left.append(p)
            centres[p], steps[p] = new, steps[p] + 1
        moving = left
    _, _, costs = cluster_sums(points, models, centres)
    return [Fitted(m, c, s, cost) for m, c, s, cost in zip(models, centres, steps, costs, strict=True)]


def best_fits(fitted: list[Fitted], of: Callable[[Model], object]) -> dict:
    """The fit of least cost for each value of ``of``; costs that agree in nine digits are equal, then the lowest seed."""
    out: dict = {}
    for f in sorted(fitted, key=lambda f: (float(f"{f.cost:.8e}"), f.model.seed)):
        out.setdefault(of(f.model), f)
    return out


def with_labels(points: DataFrame, fits: list[Fitted]) -> DataFrame:
    """``points`` with ``labels``: the nearest cluster of each of the fits, in their order."""
    names = points.columns
    sent = points.sparkSession.sparkContext.broadcast([(own, np.stack([fits[p].centres for p in own])) for _, own in same_k([f.model for f in fits])])
    at = names.index("x")

    def run(batches):
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            labels = np.empty((len(x), len(fits)), np.int32)
            rows = max(64, MATRIX // sum(len(own) * c.shape[1] for own, c in sent.value))
            for start in range(0, len(x), rows):
                for own, centres in sent.value:
                    labels[start : start + rows, own] = nearest(x[start : start + rows], centres)[0]
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(fits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(labels.ravel()))], names=[*names, "labels"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{fields}, labels array<int>")


# ----------------------------------------------------------------- silhouette
def anchors_of(labelled: DataFrame, weights: list[int], per_cluster: int, seed: int) -> DataFrame:
    """The ``per_cluster`` points of each model's clusters that come first by hash: model, label, id, x, w."""
    w = F.col("w") if "w" in labelled.columns else F.lit(None)
    count = F.lit(1.0)
    for p in sorted(set(weights) - {-1}):
        count = F.when(F.element_at(F.array(*map(F.lit, weights)), F.col("model") + 1) == p, w[p].cast("double")).otherwise(count)
    own = labelled.select("id", "x", *[c for c in ("w",) if c in labelled.columns], hash_uniform(F.col("id"), F.lit(seed), F.lit("anchor")).alias("u"),
                          F.posexplode("labels").alias("model", "label"))
    own = own.select("model", "label", "id", "x", "u", count.alias("n")).where(F.col("n") > 0)
    place = F.row_number().over(Window.partitionBy("model", "label").orderBy("u", "id"))
    return own.withColumn("_place", place).where(F.col("_place") <= per_cluster).select("model", "label", "id", "x", "n")


def sampled_silhouettes(labelled: DataFrame, n_models: int, weights: list[int] | None = None, per_cluster: int = 64, seed: int = 42) -> list[tuple[float, float]]:
    """Euclidean silhouette and its standard error for each of several labelings (``labels``) of the points.

    Each cluster gives its first ``per_cluster`` points by hash as anchors (all, where it
    has no more: the result is then the definition, with standard error 0).  One
    pass adds up the distances of every anchor to all points of each cluster; the
    mean over the points is the cluster means weighted by cluster size.  A point
    alone in its cluster scores 0; copies of a drawn point count as often as drawn.
    One cluster only: not a number.
    """
    weights = weights or [-1] * n_models
    per_model = anchors_of(labelled, weights, per_cluster, seed).collect()  # per_cluster rows for each cluster
    if not per_model:
        return [(float("nan"), float("nan"))] * n_models
    per_model.sort(key=lambda r: (r.model, r.label, r.id))
    ks = [1 + max((r.label for r in per_model if r.model == m), default=-1) for m in range(n_models)]
    at = np.array([r.x for r in per_model])
    spans = np.searchsorted([r.model for r in per_model], range(n_models + 1))
    sent = labelled.sparkSession.sparkContext.broadcast((at, spans.tolist(), ks, weights))

    def run(batches):
        at, spans, ks, weights = sent.value
        wide = max(ks)
        sums, sizes = np.zeros((len(at), wide)), np.zeros((len(ks), wide))
        for part in columns_of(batches, len(at)):
            x, d2 = part["x"], np.zeros((len(at), len(part["x"])))
            for j in range(x.shape[1]):  # differences first: copies are at distance 0 exactly
                d2 += (at[:, j : j + 1] - x[:, j]) ** 2
            away = np.sqrt(d2)
            for m, (k, w) in enumerate(zip(ks, weights, strict=True)):
                member = (part["labels"][:, m : m + 1] == np.arange(wide)) * (part["w"][:, w : w + 1] if w >= 0 else 1.0)
                sums[spans[m] : spans[m + 1]] += away[spans[m] : spans[m + 1]] @ member
                sizes[m] += member.sum(0)
        rows = np.r_[sums, sizes]
        a, c = np.nonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(c, pa.int32()), pa.array(rows[a, c])], names=["a", "c", "v"])

    columns = ["x", "labels", *[c for c in ("w",) if c in labelled.columns]]
    total = np.zeros((len(at) + n_models, max(ks)))
    for r in labelled.select(*columns).mapInArrow(run, "a int, c int, v double").groupBy("a", "c").agg(F.sum("v").alias("v")).collect():
        total[r.a, r.c] = r.v
    sent.destroy()
    out = []
    for m in range(n_models):
        own = per_model[spans[m] : spans[m + 1]]
        sizes = total[len(at) + m]
        if (sizes > 0).sum() < 2:
            out.append((float("nan"), float("nan")))
            continue
        out.append(stratified([silhouette_of(total[spans[m] + p], sizes, r.label) for p, r in enumerate(own)], own, sizes))
    return out


def silhouette_of(sums: np.ndarray, sizes: np.ndarray, label: int) -> float:
    """From the sums of a point's distances to each cluster."""
    if sizes[label] <= 1:
        return 0.0
    a = sums[label] / (sizes[label] - 1)
    b = min(s / n for c, (s, n) in enumerate(zip(sums, sizes, strict=True)) if c != label and n > 0)
    return 0.0 if max(a, b) == 0 else (b - a) / max(a, b)


def stratified(scores: list[float], anchors: list, sizes: np.ndarray) -> tuple[float, float]:
    """Mean over all points from the anchors' scores, and its standard error."""
    mean = variance = 0.0
    for c in np.flatnonzero(sizes).tolist():
        s, w = (np.array(v) for v in zip(*[(s, r.n) for s, r in zip(scores, anchors, strict=True) if r.label == c], strict=True))
        share, own = sizes[c] / sizes.sum(), (s * w).sum() / w.sum()
        mean += share * own
        sampled = w.sum() / sizes[c]
        if len(s) > 1 and sampled < 1:
            spread = (w * w * (s - own) ** 2).sum() / (w.mean() ** 2 * (len(s) - 1))
            variance += share**2 * spread / len(s) * (1 - sampled)
    return float(mean), float(np.sqrt(variance))


def cached(points: DataFrame) -> DataFrame:
    """Written points kept in memory where they fit, for the passes of a fit."""
    return points.persist(StorageLevel.MEMORY_AND_DISK)
