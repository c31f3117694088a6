"""Exact top-k by heavy-hitter summaries against counting every key."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import topk


def _first(rows, k):
    """The k largest counts of each group, equal ones by key (nulls first)."""
    out = set()
    for g in {g for g, _, _ in rows}:
        own = Counter()
        for h, key, n in rows:
            if h == g:
                own[key] += n
        order = sorted(own, key=lambda x: (-own[x], x is not None, x or ""))
        out |= {(g, key, own[key]) for key in order[:k]}
    return out


@pytest.mark.parametrize("spread, capacity, proven", [(1.6, 200, True), (1.2, 20, None), (0.0, 30, False)])
def test_candidates_hold_the_first_of_each_group(spark, spread, capacity, proven):
    rng = random.Random(3)
    keys = [f"k{i}" for i in range(400)] + [None]
    odds = [1 / (i + 1) ** spread for i in range(len(keys))]
    rows = [(rng.randrange(2), key, rng.randint(1, 3)) for key in rng.choices(keys, odds, k=6000)]
    df = spark.createDataFrame(rows, "g int, path string, w int").repartition(5)
    chosen = topk.candidates(df, ["g", "path"], ["g"], 5, "w", capacity, most_candidates=300)
    if proven is not None:
        assert (chosen is not None) == proven
    got = topk.only(df, ["g", "path"], chosen).groupBy("g", "path").agg({"w": "sum"}).collect()
    counted = {(r[0], r[1], r[2]) for r in got}
    assert _first(rows, 5) <= counted
    if proven:
        assert len(counted) < 300
        summary = topk.summaries(df, ["g", "path"], "w", capacity).count()
        assert summary <= df.rdd.getNumPartitions() * (capacity + 1)


def test_counts_without_a_group_and_without_rows(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)], "path string")
    assert {r.path for r in topk.candidates(df, ["path"], [], 2).collect()} >= {"a", "b"}
    assert topk.candidates(df.filter("false"), ["path"], [], 2).count() == 0
    assert topk.candidates(df, ["path"], [], 2, most_candidates=1) is None


def test_keys_that_are_never_null(spark):
    df = spark.range(30).select((F.col("id") % 4).alias("k"))
    solid = spark.createDataFrame(df.rdd, "k long not null")
    assert not solid.schema["k"].nullable
    assert {r.k for r in topk.candidates(solid, ["k"], [], 2).collect()} >= {0, 1}
    assert topk.candidates(solid.filter("k > 9"), ["k"], [], 2).count() == 0


def test_a_summary_is_short_by_no_more_than_its_error(spark):
    rng = random.Random(5)
    rows = [(f"k{min(rng.randrange(200), rng.randrange(200))}",) for _ in range(5000)]
    df = spark.createDataFrame(rows, "path string").coalesce(1)
    got = topk.summaries(df, ["path"], None, 25).collect()
    error = sum(r.n for r in got if r.is_error)
    true = Counter(k for k, in rows)
    held = {r.path: r.n for r in got if not r.is_error}
    assert error > 0 and len(held) <= 25
    assert all(held.get(k, 0) <= n <= held.get(k, 0) + error for k, n in true.items())
