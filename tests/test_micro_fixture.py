"""Hand-checked values on the golden micro-fixture (FIXTURES.md section 5)."""

import math

import pytest
from pyspark.sql import functions as F

import micro
from sessionlens.operators import cleaning, conversion, features, labels, paths, quality, sessions, stability


@pytest.fixture(scope="module")
def base(spark):
    raw = micro.events(spark)
    ev = cleaning.clean_events(raw)
    it = cleaning.first_per_id(micro.items(spark))
    us = cleaning.latest_per_id(micro.users(spark))
    lab = labels.add_labels(ev, it, micro.CATEGORY_MAP).events
    return dict(raw=raw, ev=ev, items=it, users=us, lab=lab, asg=micro.assignments(spark))


def _summary(rep):
    return {r["metric"]: r["value"] for r in rep.summary.collect()}


def test_duplicates_and_dedup(base):
    raw_rep = quality.check_events(base["raw"].drop("src_order"), base["items"], base["users"])
    s = _summary(raw_rep)
    assert s["duplicate_event_rows"] == "1" and s["duplicate_events_by_key"] == "1"
    assert base["ev"].count() == 9


def test_unknown_rows(base):
    s = _summary(quality.check_events(base["ev"], base["items"], base["users"]))
    assert s["events_with_unknown_item"] == "1"
    assert s["events_with_unknown_user"] == "3"
    assert s["n_events"] == "9"
    assert list(_summary(quality.check_events(base["ev"], base["items"], base["users"])).keys())[:3] == [
        "n_events", "duplicate_event_rows", "duplicate_events_by_key"]


def test_labels_and_buckets(base):
    got = {r["item_id"]: (r["content_type"], r["price_bucket"])
           for r in base["lab"].select("item_id", "content_type", "price_bucket").distinct().collect()}
    assert got == {
        100: ("Apparel", "<=10"), 101: ("Drinkware", "10-25"), 102: ("Other", "Unknown_Price"),
        103: ("Other", "100+"), 999: ("Unknown_Item", "Unknown_Price"),
    }


def test_sessions(base):
    s = sessions.session_rollup(base["lab"])
    got = {r["session_key"]: (r["n_events"], r["n_unique_items"], r["n_purchases"], r["n_add_to_cart"],
                              r["session_duration_sec"]) for r in s.collect()}
    assert got == {"1_10": (3, 2, 1, 2, 120.0), "1_11": (1, 1, 0, 1, 0.0),
                   "2_20": (2, 2, 1, 1, 300.0), "3_30": (3, 2, 1, 1, 240.0)}


def test_entropy_and_user_features(base):
    s = sessions.session_rollup(base["lab"])
    uf = features.build_user_features(base["lab"], s, base["users"], micro.CATEGORY_MAP).user_features
    rows = {r["user_id"]: r for r in uf.collect()}
    assert rows[1]["content_entropy"] == pytest.approx(1.039721, abs=1e-6)
    assert rows[2]["content_entropy"] == pytest.approx(0.693147, abs=1e-6)
    assert rows[3]["content_entropy"] == pytest.approx(0.636514, abs=1e-6)
    u1 = rows[1]
    assert (u1["n_sessions"], u1["mean_session_duration"], u1["purchase_rate_sessions"],
            u1["add_to_cart_rate_sessions"], u1["mean_events_per_session"],
            u1["mean_unique_items_per_session"]) == (2, 60.0, 0.5, 1.0, 2.0, 1.5)
    assert rows[3]["ltv"] == 0.0  # unknown user -> zero-filled
    shares = [c for c in uf.columns if c.startswith("share_content_")]
    for r in rows.values():
        assert sum(r[c] for c in shares) == pytest.approx(1.0)


def test_journeys_transitions_funnel(base):
    j = paths.build_session_journeys(base["lab"])
    got = {r["session_key"]: r["path"] for r in j.collect()}
    assert got == {"1_10": "add_to_cart > purchase", "2_20": "purchase > add_to_cart",
                   "3_30": "add_to_cart > begin_checkout > purchase"}
    t = {(r["from"], r["to"]): r["p"] for r in paths.transition_counts(j).collect()}
    assert t == {("add_to_cart", "purchase"): 0.5, ("add_to_cart", "begin_checkout"): 0.5,
                 ("begin_checkout", "purchase"): 1.0, ("purchase", "add_to_cart"): 1.0}
    f = [tuple(r) for r in paths.funnel(j).collect()]
    assert f == [("sessions", 3, 1.0, 1.0), ("add_to_cart", 3, 1.0, 1.0), ("purchase", 3, 1.0, 1.0)]
    lift = paths.segment_path_lift(j, base["asg"]).collect()
    assert sorted(r["segment_id"] for r in lift) == [-1, 0, 1]
    assert all(r["lift"] == pytest.approx(3.0) for r in lift)


def test_conversion(base):
    s = sessions.session_rollup(base["lab"])
    rows = [tuple(r) for r in conversion.segment_conversion(s, base["asg"]).collect()]
    assert rows[0] == (1, 1, 1, 1.0, 1.0, 1.0, 0.0)
    assert rows[1] == (0, 1, 2, 1.0, 0.5, 0.5, 0.5)
    assert rows[2] == (2, 1, None, None, None, 0.0, 1.0)


def test_weekly_shares_and_drift(base):
    sh = stability.segment_shares(base["ev"], base["asg"], "W")
    got = {(str(r["period"].date()), r["segment_id"]): r["share"] for r in sh.collect()}
    third = 1.0 / 3.0
    assert got == pytest.approx({("2024-01-01", -1): third, ("2024-01-01", 0): third,
                                 ("2024-01-01", 1): third, ("2024-01-08", 0): 1.0})
    d = stability.temporal_drift(sh).collect()
    assert len(d) == 1
    assert d[0]["l1_drift"] == pytest.approx(4.0 / 3.0)
    assert d[0]["psi_drift"] == pytest.approx(12.28045, abs=1e-4)


def test_standalone_drift_numbers(spark):
    sh = spark.createDataFrame(
        [("2024-01-01", 0, 0.5), ("2024-01-01", 1, 0.5), ("2024-02-01", 0, 0.25), ("2024-02-01", 1, 0.5),
         ("2024-02-01", 2, 0.25)], "p string, segment_id int, share double",
    ).select(F.col("p").cast("timestamp_ntz").alias("period"), "segment_id", "share")
    d = stability.temporal_drift(sh).first()
    assert d["l1_drift"] == pytest.approx(0.5)
    assert d["psi_drift"] == pytest.approx(4.43188340, abs=1e-7)
    summ = {r["metric"]: r["value"] for r in stability.stability_summary(stability.temporal_drift(sh), None).collect()}
    assert summ["temporal_l1_mean"] == pytest.approx(0.5)
    assert math.isnan(summ["bootstrap_ari_mean"])
