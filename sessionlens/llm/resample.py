"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams (unigrams and bigrams in
``buckets`` buckets, add-``smoothing``) are estimated: one from the target texts
(rows labelled good), one from all texts.  The log importance weight of a
document is the sum over its n-grams of the log ratio of the two; ``score`` is
that ratio per n-gram.  Resampling without replacement in proportion to the
weights is Gumbel top-k: a Gumbel number drawn from a hash of the id is added to
the log weight, and the ``keep`` share of documents with the largest sums is kept.

The log weight is that sum.  ``per_word`` is another weighting beside it, the mean
log ratio times ``sharpness``.  Rows of one id (null ids, too) share their Gumbel number.

The counts cover every text: each task adds up its own buckets, and only sums
per bucket (at most twice ``buckets`` numbers) reach the driver.  The target is
the labelled rows, at most ``max_labels`` of them by the smallest hash of their
id.  The k-th largest sum is found exactly by counting in ever narrower bins
over a written (id, key) table.  Documents whose sums are equal at the limit
are kept or left together, so that equal rows fare alike.

Null and empty texts have no n-grams: weight 0, never kept.  Without target
rows all weights are 0 and the choice is random.  An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from sessionlens.llm.common import Remembered, each, id_and_text, kept_by_worker, map_texts, slices
from sessionlens.session import written


@dataclass(frozen=True)
class ResampleSettings:
    buckets: int = 1 << 16
    smoothing: float = 1.0
    keep: float = 0.85
    per_word: bool = False
    sharpness: float = 50.0
    max_labels: int = 20_000
    seed: int = 42


#: Word hashes that a Python worker remembers per generation.
REMEMBERED_WORDS = 400_000


class Grams:
    """Buckets of the words and word pairs of texts; words are cut at ASCII white space, ASCII letters lower-cased."""

    def __init__(self, buckets: int) -> None:
        self.shift = np.uint32(33 - buckets.bit_length())
        self.codes = Remembered(zlib.crc32, REMEMBERED_WORDS)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        codes = np.fromiter(map(self.codes.__getitem__, words), np.uint32, len(words))
        pairs = (codes[:-1] * np.uint32(0x85EBCA6B)) ^ (codes[1:] + np.uint32(0x165667B1))
        mixed = np.concatenate([codes, pairs])
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x9E3779B1)
        return (mixed >> self.shift).astype(np.int64)


def grams_of_worker(buckets: int) -> Grams:
    return kept_by_worker(f"grams {buckets}", lambda: Grams(buckets))


def gram_counts(docs: DataFrame, target: DataFrame, settings: ResampleSettings, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over the target texts and over all texts."""
    n = settings.buckets
    marked = id_and_text(docs, id_col, text_col).join(
        F.broadcast(target.select(F.col("doc_id"), F.lit(True).alias("good"))), "doc_id", "left"
    ).select("good", "text")

    def run(batches):
        grams = grams_of_worker(n)
        sums = np.zeros((2, n), np.int64)
        for part in slices(batches):
            for good, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = grams(text)
                if len(own) < n // 8:
                    np.add.at(sums[1], own, 1)
                    if good:
                        np.add.at(sums[0], own, 1)
                else:
                    own = np.bincount(own, minlength=n)
                    sums[1] += own
                    if good:
                        sums[0] += own
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "good", "raw"])

    out = np.zeros((2, n), np.int64)
    partial = marked.mapInArrow(run, "bucket long, good long, raw long")
    for r in partial.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw")).toLocalIterator():
        out[:, r.bucket] = r.good, r.raw
    return out[0], out[1]


def log_ratios(good: np.ndarray, raw: np.ndarray, smoothing: float) -> np.ndarray:
    """Log of target over raw probability per bucket."""
    if not good.sum():
        return np.zeros(len(good))
    p, q = good + smoothing, raw + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def largest(keys: DataFrame, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of the column ``key`` (None if it has fewer values)."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n < k or k < 1:
        return None
    while low < high:
        width = (high - low) / bins
        if not low + width > low or not high - width < high:
            break  # neighbouring doubles
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        counts = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        for r in sorted(counts, key=lambda r: -r.bin):  # at most `bins` rows
            if k <= r.n:
                low, high = r.a, r.b
                break
            k -= r.n
    return high


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    settings: ResampleSettings = ResampleSettings(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``n_grams``, ``log_weight``, ``score``, ``key`` and ``kept``.

    ``target``: the doc_ids of good texts in a column ``doc_id``.
    """
    spark = docs.sparkSession
    target = target.select("doc_id").filter("doc_id is not null").distinct()
    target = target.orderBy(F.xxhash64("doc_id", F.lit(settings.seed)), "doc_id").limit(settings.max_labels)
    ratios = log_ratios(*gram_counts(docs, target, settings, id_col, text_col), settings.smoothing)
    sent = spark.sparkContext.broadcast(ratios)
    n = settings.buckets

    def make():
        grams, table = grams_of_worker(n), sent.value

        def row(text):
            own = grams(text)
            return len(own), float(table[own].sum())

        return each(row)

    weights = map_texts(docs, make, [("n_grams", LongType()), ("log_weight", DoubleType())], id_col, text_col)
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(settings.seed)), 11) + 0.5) / float(1 << 53)
    score = F.when(F.col("n_grams") > 0, F.col("log_weight") / F.col("n_grams")).otherwise(0.0)
    weight = F.col("score") * settings.sharpness if settings.per_word else F.col("log_weight")
    keyed = written(
        weights.withColumn("score", score).withColumn("key", F.when(F.col("n_grams") > 0, weight - F.log(-F.log(u)))), "resample-keys"
    )
    limit = largest(keyed, int(settings.keep * keyed.count()))
    kept = F.coalesce(F.col("key") >= F.lit(limit), F.lit(False)) if limit is not None else F.col("key").isNotNull()
    return keyed.withColumn("kept", kept)
