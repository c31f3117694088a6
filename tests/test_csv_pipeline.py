"""End-to-end run on CSV files: unknown references, a duplicate, null cells, dates in another spelling."""

import glob
import os

import pytest

from sessionlens.operators.bootstrap import bootstrap_stability
from sessionlens.plans.pipeline import PipelineConfig, run_pipeline
from sessionlens.sources.csv_loader import load_all, load_events

EVENTS = "user_id,ga_session_id,country,device,type,item_id,date"
TYPES = ["view", "add_to_cart", "purchase", "view"]


def write_raw(folder, date="{m:02d}/{d:02d}/2021 10:{i:02d}:00"):
    rows = []
    for user in range(1, 13):
        for session in range(1 + user % 3):
            for i in range(2 + (user + session) % 4):
                when = date.format(m=1 + session, d=1 + user, i=i)
                rows.append(f"{user},{session},{'US' if user % 2 else ''},mobile,{TYPES[i % 4]},{1 + (user * i) % 5},{when}")
    rows.append(rows[0])  # a duplicate
    rows.append("1,0,US,,view,999," + date.format(m=1, d=2, i=59))  # an unknown item, no device
    rows.append("77,0,DE,desktop,view,1," + date.format(m=2, d=2, i=1))  # an unknown user
    (folder / "events1.csv").write_text("\n".join([EVENTS, *rows]) + "\n")
    items = [f"{i},item {i},brand,,{'Apparel' if i % 2 else 'Bags'},{i * 9}" for i in range(1, 6)]
    (folder / "items.csv").write_text("\n".join(["id,name,brand,variant,category,price_in_usd", *items]) + "\n")
    users = [f"{u},{u * 3},01/01/2020" for u in range(1, 13)]
    (folder / "users.csv").write_text("\n".join(["id,ltv,date", *users]) + "\n")
    return len(rows)


ARTIFACTS = [
    "data/interim/events_labeled_sessionized", "data/interim/sessions", "data/processed/user_features",
    "results/segments/user_segments", "results/segments/user_segments_csv", "results/segments/segment_profile",
    *[f"results/tables/{t}" for t in (
        "data_quality_summary", "data_quality_event_nulls", "data_quality_missing_items", "data_quality_missing_users",
        "sessions_head", "content_type_event_counts", "user_features_head", "k_selection_metrics",
        "segment_conversion_analysis", "segment_atc_purchase_table", "segment_leakage_size_table", "journeys_sessions",
        "journeys_top_paths", "journeys_funnel", "journeys_transition_matrix", "journeys_segment_path_lift",
        "stability_temporal_segment_shares", "stability_temporal_drift", "stability_bootstrap", "stability_summary")],
]


def test_csv_run_writes_every_artifact(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    n_rows = write_raw(raw)
    cfg = PipelineConfig(k_range=range(2, 4), n_init=2, max_iter=20, with_journeys=True, with_stability=True, bootstrap_runs=2)
    art = run_pipeline(spark, load_all(spark, str(raw)), str(tmp_path / "out"), cfg)
    assert art.dedup_removed == 1 and art.events.count() == n_rows - 1
    for rel in ARTIFACTS:
        files = glob.glob(os.path.join(tmp_path, "out", rel, "part-*"))
        assert files, rel
        for f in files:
            if f.endswith(".csv"):
                assert "src_order" not in open(f).readline(), rel
    dq = {r.metric: r.value for r in art.dq.summary.collect()}
    assert dq["events_with_unknown_item"] == "1" and dq["events_with_unknown_user"] == "1"
    assert {r.month for r in art.events.selectExpr("month(date) AS month").distinct().collect()} == {1, 2, 3}
    steps = {r["from"] for r in art.journeys.transition_matrix.collect()}
    assert steps == {r["from"] for r in art.journeys.transitions.collect()} != set()


def test_mixed_date_spellings_are_refused(spark, tmp_path):
    path = tmp_path / "events1.csv"
    path.write_text(f"{EVENTS}\n1,1,US,m,view,1,2021-03-01\n1,1,US,m,view,2,2021-03-01 10:00:00\n")
    with pytest.raises(Exception, match="not a timestamp"):
        load_events(spark, str(path)).collect()
    path.write_text(f"{EVENTS}\n1,1,US,m,view,1,2021-03-01 10:00:00.5\n1,1,US,m,view,2,2021-03-02 10:00:00.125\n")
    assert [r.date.microsecond for r in load_events(spark, str(path)).orderBy("item_id").collect()] == [500_000, 125_000]


def test_bootstrap_refuses_repeated_users(spark):
    features = spark.createDataFrame([(u, float(u % 3), float(u % 5)) for u in range(30)], "user_id long, a double, b double")
    labels = spark.createDataFrame([(u, u % 3) for u in range(30)] * 2, "user_id long, segment_id int")
    with pytest.raises(Exception, match="not unique"):
        bootstrap_stability(features, labels, ["a", "b"], 3, runs=1, n_init=1)
