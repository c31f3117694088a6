"""Trap fixtures (FIXTURES.md section 6): one test per behaviour that is easy to get wrong."""

import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import period_start
from sessionlens.operators import cleaning, conversion, features, labels, paths, sessions
from sessionlens.sources import csv_loader

EV_SCHEMA = "src_order long, user_id long, ga_session_id long, item_id long, date timestamp_ntz, type string, device string, country string"
T0 = datetime(2024, 1, 1)


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)
    return path


@pytest.fixture(scope="module")
def csv_dir():
    d = tempfile.mkdtemp(prefix="sessionlens-csv-")
    _write(os.path.join(d, "events1.csv"),
           "user_id,ga_session_id,country,device,type,item_id,date,extra\n"
           "1,10,NA,\" a\t\",view,5,2024-01-01 00:00:00,x\n"
           "1,10,null,,view,6,2024-01-01 00:00:01,NA\n"
           "1.5,10,None,d,view,7,2024-01-01 00:00:02,\n"
           "-1.7,10,n/a,d,view,7,2024-01-01 00:00:03,\n"
           "1,10,-,d,purchase,7,2024-01-01 00:00:04,\n"
           "1,10, ,d,,7,2024-01-01 00:00:05,\n"
           "1,10, NA ,d,view,5,2024-01-01 00:00:00,dup\n")
    _write(os.path.join(d, "items.csv"),
           "id,name,brand,variant,category,price_in_usd\n"
           "5,a,b,v, Apparel ,12.5\n5,dup,b,v,Bags,1\n6,c,b,v,,abc\n")
    _write(os.path.join(d, "users.csv"),
           "id,ltv,date\n1,5,2024-01-01\n1,7,\n1,9,2024-02-01\n2,bad,2024-01-01\n")
    _write(os.path.join(d, "bad_ids.csv"),
           "user_id,ga_session_id,country,device,type,item_id,date\nx,1,US,d,view,1,2024-01-01\n")
    _write(os.path.join(d, "null_ids.csv"),
           "user_id,ga_session_id,country,device,type,item_id,date\n,1,US,d,view,1,2024-01-01\n")
    _write(os.path.join(d, "missing_cols.csv"), "user_id,type\n1,view\n")
    return d


def test_na_texts_and_strip(spark, csv_dir):
    raw = csv_loader.read_text_csv(spark, os.path.join(csv_dir, "events1.csv"), "events")
    rows = cleaning.fill_country(csv_loader.parse_events(raw)).orderBy("src_order").collect()
    countries = [r["country"] for r in rows]
    # NA/null/None/n/a -> Unknown; '-' stays; a blank becomes ''; ' NA ' is text, stripped to 'NA'
    assert countries == ["Unknown", "Unknown", "Unknown", "Unknown", "-", "", "NA"]
    assert rows[0]["device"] == "a"  # strip removes tab and spaces
    assert rows[1]["device"] is None  # empty cell -> null
    assert rows[0]["extra"] == "x" and rows[1]["extra"] is None  # extra column passes through, NA -> null
    assert rows[5]["type"] is None


def test_int_text_and_null_type_row(spark, csv_dir):
    ev = csv_loader.load_events(spark, os.path.join(csv_dir, "events1.csv"))
    users = sorted(r["user_id"] for r in ev.collect())
    assert -1 in users and users.count(1) >= 3  # '1.5' -> 1, '-1.7' -> -1
    assert ev.where(F.col("type").isNull()).count() == 0  # null type row dropped
    # the duplicate key (user 1, session 10, item 5, same date, view) keeps the first row
    assert ev.where((F.col("item_id") == 5)).count() == 1


def test_dedup_report_counts_removed_rows(spark, csv_dir):
    report = cleaning.DedupReport()
    ev = csv_loader.load_events(spark, os.path.join(csv_dir, "events1.csv"), report=report)
    ev.write.format("noop").mode("overwrite").save()
    assert report.removed == 1  # the ' NA ' row repeats the first row's key


def test_strict_ids_raise(spark, csv_dir):
    for name in ("bad_ids.csv", "null_ids.csv"):
        with pytest.raises(Exception):
            csv_loader.load_events(spark, os.path.join(csv_dir, name)).collect()


def test_missing_file_and_columns(spark, csv_dir):
    with pytest.raises(FileNotFoundError):
        csv_loader.load_events(spark, os.path.join(csv_dir, "nope.csv"))
    with pytest.raises(ValueError, match=r"columns not found: \['country', 'date'"):
        csv_loader.load_events(spark, os.path.join(csv_dir, "missing_cols.csv"))


def test_items_first_and_coerced_price(spark, csv_dir):
    it = {r["id"]: r for r in csv_loader.load_items(spark, os.path.join(csv_dir, "items.csv")).collect()}
    assert it[5]["name"] == "a" and it[5]["category"] == "Apparel" and it[5]["price_in_usd"] == 12.5
    assert it[6]["price_in_usd"] is None and it[6]["category"] is None


def test_users_latest_null_date_wins(spark, csv_dir):
    us = {r["id"]: r for r in csv_loader.load_users(spark, os.path.join(csv_dir, "users.csv")).collect()}
    assert us[1]["ltv"] == 7.0 and us[1]["date"] is None
    assert us[2]["ltv"] == 0.0  # junk ltv -> null -> 0.0


def test_bucket_edges(spark):
    vals = [-1.0, -0.01, -0.005, 0.0, 10.0, 10.01, 25.0, 50.0, 100.0, 100.5, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r[0] for r in df.select(labels.price_bucket_expr(F.col("p"))).collect()]
    assert got == [None, None, "<=10", "<=10", "<=10", "10-25", "10-25", "25-50", "50-100", "100+", "100+", None, None]


def _events(spark, rows):
    return spark.createDataFrame(rows, EV_SCHEMA)


def test_first_non_null_device_and_subsecond_duration(spark):
    ev = _events(spark, [
        (0, 1, 1, 1, T0, "view", None, "US"),
        (1, 1, 1, 2, T0 + timedelta(milliseconds=1900), "view", "x", "US"),
    ])
    s = sessions.session_rollup(ev).first()
    assert s["device"] == "x"
    assert s["session_duration_sec"] == 1.9


def test_single_content_type_entropy_is_positive_zero(spark):
    ev = _events(spark, [(0, 1, 1, 1, T0, "view", "d", "US")]).withColumn("content_type", F.lit("Apparel"))
    e = features.user_event_features(ev, ["Apparel", "Other"]).first()["content_entropy"]
    assert e == 0.0 and str(e) == "0.0"


def test_efficiency_edges(spark):
    s = spark.createDataFrame(
        [(1, False, True), (2, True, False), (2, True, True), (3, False, True), (3, True, False)],
        "user_id long, has_add_to_cart boolean, has_purchase boolean")
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "user_id long, segment_id int")
    rows = {r["segment_id"]: r for r in conversion.segment_conversion(s, a).collect()}
    assert rows[0]["conversion_efficiency"] == 0.0 and rows[0]["conversion_leakage"] == 1.0  # atc 0, purchases 1
    assert rows[1]["conversion_efficiency"] == 0.5
    assert rows[2]["conversion_efficiency"] == 1.0  # purchase = atc


def test_same_instant_order_and_repeats(spark):
    ev = _events(spark, [
        (5, 1, 1, 20, T0, "purchase", "d", "US"),
        (3, 1, 1, 10, T0, "view", "d", "US"),       # same instant: item 10 before item 20
        (9, 2, 1, 1, T0, "view", "d", "US"),
        (8, 2, 1, 1, T0 + timedelta(seconds=1), "view", "d", "US"),
        (7, 2, 1, 1, T0 + timedelta(seconds=2), "view", "d", "US"),  # [view, view, view] -> 1 step -> dropped
    ])
    j = {r["user_id"]: r["path"] for r in paths.build_session_journeys(ev).collect()}
    assert j == {1: "view > purchase"}


def test_truncation_flags_from_all_events(spark):
    types = ["view", "error", "view", "error", "purchase"]
    ev = _events(spark, [(i, 1, 1, i, T0 + timedelta(seconds=i), t, "d", "US") for i, t in enumerate(types)])
    r = paths.build_session_journeys(ev, paths.JourneyConfig(max_steps=3)).first()
    assert r["n_steps"] == 3 and r["path"] == "view > error > view" and r["has_purchase"] and r["n_events"] == 5


def test_target_only_state_in_wide_matrix(spark):
    ev = _events(spark, [(0, 1, 1, 1, T0, "view", "d", "US"), (1, 1, 1, 1, T0 + timedelta(seconds=1), "purchase", "d", "US")])
    m = paths.transition_matrix(paths.transition_counts(paths.build_session_journeys(ev)))
    assert m.columns == ["from", "purchase"]
    assert [tuple(r) for r in m.collect()] == [("view", 1.0)]


def test_duplicate_item_id_raises(spark):
    ev = _events(spark, [(0, 1, 1, 1, T0, "view", "d", "US")])
    it = spark.createDataFrame([(1, "a"), (1, "b")], "id long, category string").select(
        "id", F.lit("n").alias("name"), F.lit("b").alias("brand"), F.lit("v").alias("variant"), "category",
        F.lit(1.0).alias("price_in_usd"))
    with pytest.raises(Exception, match="not unique"):
        labels.add_labels(ev, it).events.collect()


def test_week_floor_and_period_gap(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 7, 23, 0),)], "d timestamp_ntz")
    assert df.select(period_start(F.col("d"), "W")).first()[0] == datetime(2024, 1, 1)
    from sessionlens.operators import stability

    ev = _events(spark, [
        (0, 1, 1, 1, datetime(2024, 1, 5), "view", "d", "US"),
        (1, 2, 1, 1, datetime(2024, 3, 5), "view", "d", "US"),
    ])
    a = spark.createDataFrame([(1, 0), (2, 1)], "user_id long, segment_id int")
    d = stability.temporal_drift(stability.segment_shares(ev, a, "M")).collect()
    assert [(r["prev_period"].month, r["period"].month) for r in d] == [(1, 3)]  # February skipped
    assert d[0]["l1_drift"] == 2.0


def test_null_step_raises(spark):
    ev = _events(spark, [(0, 1, 1, 1, T0, None, "d", "US"), (1, 1, 1, 1, T0, "view", "d", "US")])
    with pytest.raises(Exception, match="journey step is null"):
        paths.build_session_journeys(ev).collect()


def test_bad_step_mode():
    with pytest.raises(ValueError):
        paths.JourneyConfig(step_mode="nope")


def test_dq_negative_duration_metric_only_when_column_present(spark):
    from sessionlens.operators import quality

    ev = _events(spark, [(0, 1, 1, 1, T0, "view", "d", "US"), (1, 1, 1, 2, T0, "view", "d", "US")])
    it = spark.createDataFrame([(1,)], "id long")
    us = spark.createDataFrame([(1,)], "id long")
    plain = {r["metric"] for r in quality.check_events(ev, it, us).summary.collect()}
    assert "negative_session_duration" not in plain
    with_dur = ev.withColumn("session_duration_sec", F.when(F.col("item_id") == 2, -1.0).otherwise(3.0))
    summ = [(r["metric"], r["value"]) for r in quality.check_events(with_dur, it, us).summary.collect()]
    assert summ[-1] == ("negative_session_duration", "1")
    assert dict(summ)["events_with_unknown_item"] == "1"
    assert [m for m, _ in summ][:4] == ["n_events", "duplicate_event_rows", "duplicate_events_by_key", "columns_with_nulls"]


def test_repeated_assignment_fails_instead_of_fanning_out(spark):
    ev = _events(spark, [(0, 1, 1, 1, T0, "purchase", "d", "US")])
    a = spark.createDataFrame([(1, 0), (1, 1)], "user_id long, segment_id int")
    with pytest.raises(Exception, match="not unique"):
        conversion.segment_conversion(sessions.session_rollup(ev), a).collect()
    from sessionlens.operators import stability

    with pytest.raises(Exception, match="not unique"):
        stability.segment_shares(ev, a, "M").collect()
