"""Property checks: results do not depend on partitioning; shares and rates are consistent."""

import datetime
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import cleaning, conversion, labels, paths, sessions, stability
from sessionlens.sources import driver_tables as dt

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lab(spark):
    ev = cleaning.clean_events(dt.raw_events(spark, SF))
    it = cleaning.first_per_id(dt.items(spark, SF))
    return labels.add_labels(ev, it, dt.PART_CATEGORY_MAP).events


def _rows(df):
    return sorted(tuple(r) for r in df.drop("steps").collect())


@pytest.mark.parametrize("n", [1, 7])
def test_repartition_invariance(spark, lab, n):
    base_s = _rows(sessions.session_rollup(lab))
    base_j = _rows(paths.build_session_journeys(lab))
    shuffled = lab.repartition(n)
    assert _rows(sessions.session_rollup(shuffled)) == base_s
    assert _rows(paths.build_session_journeys(shuffled)) == base_j


def test_transition_rows_sum_to_one(lab):
    t = paths.transition_counts(paths.build_session_journeys(lab))
    for r in t.groupBy("from").agg(F.sum("p").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0)


def test_shares_sum_to_one_and_efficiency_plus_leakage(spark, lab):
    asg = dt.deterministic_assignments(lab)
    sh = stability.segment_shares(lab, asg, "W")
    for r in sh.groupBy("period").agg(F.sum("share").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0)
    conv = conversion.segment_conversion(sessions.session_rollup(lab), asg)
    for r in conv.collect():
        assert r["conversion_efficiency"] + r["conversion_leakage"] == pytest.approx(1.0)


def test_golden_counts_sf0001(lab, spark):
    assert lab.count() == 1035
    s = sessions.session_rollup(lab)
    assert s.count() == 165
    assert s.where("has_purchase").count() == 119 and s.where("has_add_to_cart").count() == 117
    j = paths.build_session_journeys(lab)
    assert j.count() == 149
    f = {r["step"]: r["n_sessions"] for r in paths.funnel(j).collect()}
    assert f == {"sessions": 149, "add_to_cart": 114, "purchase": 116}


@pytest.mark.parametrize("hot", [1, 3, 10])
def test_journey_chunking_does_not_change_results(lab, hot):
    """Forcing (almost) every session to be 'hot' splits it into time chunks; results stay the same."""
    base = _rows(paths.build_session_journeys(lab))
    got = _rows(paths.build_session_journeys(lab, paths.JourneyConfig(hot_session_rows=hot, hot_chunks=64)))
    assert got == base
    cfg = dict(max_steps=3, drop_repeats=False)
    assert _rows(paths.build_session_journeys(lab, paths.JourneyConfig(hot_session_rows=hot, hot_chunks=5, **cfg))) == _rows(
        paths.build_session_journeys(lab, paths.JourneyConfig(**cfg)))


def test_shares_of_periods_hold_no_set_of_user_periods(spark):
    """The same shares as of each kind of period by itself, and no aggregate with a row per (user, period)."""
    rng = random.Random(8)
    start = datetime.datetime(2023, 12, 28)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *(start + datetime.timedelta(hours=rng.randint(0, 1500)) for _ in range(9))])) for _ in range(600)]
    events = spark.createDataFrame(rows, "user_id long, date timestamp_ntz")
    assigned = spark.createDataFrame([(u, [0, 1, None, -1][u % 4]) for u in range(11)], "user_id long, segment_id int")
    got = stability.segment_shares_of_periods(events, assigned, ("W", "M", "D"))
    want = {(p, *r) for p in "WMD" for r in stability.segment_shares(events, assigned, p).collect()}
    assert len(want) > 60 and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    plan = re.sub(r"#\d+L?", "", got._jdf.queryExecution().optimizedPlan().toString())
    assert "Aggregate [user_id, day]" in plan and "Aggregate [user_id, segment_id, " not in plan


def test_partitions_of_monthly_events_go_by_rows(spark, monkeypatch):
    plain = dt.monthly_events(spark, SF)
    monkeypatch.setattr(dt, "EVENTS_A_PARTITION", 100)
    cut = dt.monthly_events(spark, SF)
    n = -(-dt.table(spark, SF, "lineitem").count() // 100)
    assert n > 40 and cut.rdd.getNumPartitions() == n
    assert Counter(plain.collect()) == Counter(cut.collect())
    assert dt.partitions_for(0, 8) is None and dt.partitions_for(800, 8) is None and dt.partitions_for(801, 8) == 9
