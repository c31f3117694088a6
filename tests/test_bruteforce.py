"""Randomised fixtures checked against plain-Python brute force."""

import math
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
import pytest

from sessionlens.operators import paths, stability

EV = "src_order long, user_id long, ga_session_id long, item_id long, date timestamp_ntz, type string, device string, country string"
TYPES = ["view", "add_to_cart", "purchase", "begin_checkout"]


def _random_events(seed, n_sessions=120):
    rng = np.random.default_rng(seed)
    rows, src = [], 0
    for s in range(n_sessions):
        user = int(rng.integers(0, 40))
        n = int(rng.integers(1, 25))
        base = datetime(2024, 1, 1) + timedelta(hours=int(rng.integers(0, 500)))
        for _ in range(n):
            # few distinct seconds and items -> many same-instant ties and repeats
            t = base + timedelta(seconds=int(rng.integers(0, 6)) * 30)
            rows.append((src, user, s, int(rng.integers(0, 4)), t, TYPES[int(rng.integers(0, 3 if s % 2 else 4))],
                         "d", "US"))
            src += 1
    return rows


def _brute_journeys(rows, max_steps, min_events, drop_repeats):
    by = defaultdict(list)
    for r in rows:
        by[(r[1], r[2])].append(r)
    out = {}
    for key, evs in by.items():
        evs.sort(key=lambda r: (r[4], r[3], r[0]))
        steps = [r[5] for r in evs]
        if drop_repeats:
            steps = [s for i, s in enumerate(steps) if i == 0 or s != steps[i - 1]]
        if len(steps) < min_events:
            continue
        steps = steps[:max_steps]
        out[key] = (" > ".join(steps), len(steps), len(evs), any(r[5] == "add_to_cart" for r in evs),
                    any(r[5] == "purchase" for r in evs))
    return out


@pytest.mark.parametrize("seed,max_steps,drop,hot", [(1, 30, True, 4), (2, 3, True, 2), (3, 5, False, 3), (4, 30, True, 10 ** 9)])
def test_journeys_match_brute_force(spark, seed, max_steps, drop, hot):
    rows = _random_events(seed)
    df = spark.createDataFrame(rows, EV)
    cfg = paths.JourneyConfig(max_steps=max_steps, drop_repeats=drop, hot_session_rows=hot, hot_chunks=97)
    got = {(r["user_id"], r["ga_session_id"]): (r["path"], r["n_steps"], r["n_events"], r["has_add_to_cart"],
                                                 r["has_purchase"])
           for r in paths.build_session_journeys(df, cfg).collect()}
    want = _brute_journeys(rows, max_steps, 2, drop)
    assert got == want
    from sessionlens.operators import sessions as sessions_op

    via_sessions = {(r["user_id"], r["ga_session_id"]): r["path"]
                    for r in paths.build_session_journeys(df, cfg, sessions_op.session_rollup(df)).collect()}
    assert via_sessions == {k: v[0] for k, v in want.items()}
    pairs = Counter()
    for path, *_ in want.values():
        st = path.split(" > ")
        pairs.update(zip(st[:-1], st[1:]))
    t = {(r["from"], r["to"]): r["count"] for r in paths.transition_counts(paths.build_session_journeys(df, cfg)).collect()}
    assert t == dict(pairs)


def _brute_ari(a, b):
    n = len(a)
    same_a = [a[i] == a[j] for i, j in combinations(range(n), 2)]
    same_b = [b[i] == b[j] for i, j in combinations(range(n), 2)]
    tp = sum(x and y for x, y in zip(same_a, same_b))
    fp = sum((not x) and y for x, y in zip(same_a, same_b))
    fn = sum(x and (not y) for x, y in zip(same_a, same_b))
    tn = sum((not x) and (not y) for x, y in zip(same_a, same_b))
    if fn == 0 and fp == 0:
        return 1.0
    return 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_ari_matches_pair_counting(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 4, 80).tolist()
    b = [x if rng.random() < 0.6 else int(rng.integers(0, 5)) for x in a]
    df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))], "id long, t int, p int")
    assert stability.adjusted_rand_index(df, "t", "p").first()["ari"] == pytest.approx(_brute_ari(a, b), abs=1e-12)


def test_drift_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    periods = [datetime(2024, m, 1) for m in (1, 2, 4, 5, 9)]  # gaps are skipped
    rows = []
    for p in periods:
        segs = sorted(rng.choice(5, size=int(rng.integers(1, 5)), replace=False).tolist())
        w = rng.random(len(segs))
        for s, x in zip(segs, w / w.sum()):
            rows.append((p, int(s), float(x)))
    df = spark.createDataFrame(rows, "period timestamp_ntz, segment_id int, share double")
    got = {r["period"]: (r["prev_period"], r["l1_drift"], r["psi_drift"]) for r in stability.temporal_drift(df).collect()}
    table = defaultdict(dict)
    for p, s, x in rows:
        table[p][s] = x
    segs = sorted({s for _, s, _ in rows})
    assert len(got) == len(periods) - 1
    for prev, cur in zip(periods[:-1], periods[1:]):
        a = [table[cur].get(s, 0.0) for s in segs]
        b = [table[prev].get(s, 0.0) for s in segs]
        l1 = sum(abs(x - y) for x, y in zip(a, b))
        psi = sum((x - y) * math.log((x + 1e-8) / (y + 1e-8)) for x, y in zip(a, b))
        assert got[cur][0] == prev
        assert got[cur][1] == pytest.approx(l1) and got[cur][2] == pytest.approx(psi)


def test_hot_session_with_one_timestamp_is_split_and_exact(spark):
    """A single session holding most rows, all at one instant, still gives the exact path."""
    rng = np.random.default_rng(11)
    t = datetime(2024, 1, 1)
    rows = [(i, 1, 1, int(rng.integers(0, 3)), t, TYPES[int(rng.integers(0, 3))], "d", "US") for i in range(3000)]
    rows += [(10_000 + i, 2, 2, 1, t + timedelta(seconds=i), "view" if i % 2 else "purchase", "d", "US") for i in range(5)]
    df = spark.createDataFrame(rows, EV)
    cfg = paths.JourneyConfig(max_steps=40, hot_session_rows=100, hot_chunks=16)
    j = paths.build_session_journeys(df, cfg)
    got = {(r["user_id"], r["ga_session_id"]): (r["path"], r["n_steps"], r["n_events"], r["has_add_to_cart"],
                                                 r["has_purchase"]) for r in j.collect()}
    assert got == _brute_journeys(rows, 40, 2, True)
    # the hot rows really are spread over several chunks
    chunks = (df.where("user_id = 1").repartitionByRange(16, "user_id", "ga_session_id", "date", "item_id", "src_order")
              .select(F.spark_partition_id().alias("p")).distinct().count())
    assert chunks > 1
