"""Empty and degenerate inputs give typed empty outputs, not errors."""

import math
from datetime import datetime, timedelta

from sessionlens.operators import conversion, paths, sessions, stability

EV = "src_order long, user_id long, ga_session_id long, item_id long, date timestamp_ntz, type string, device string, country string"


def test_no_journeys_gives_typed_empty_outputs(spark):
    ev = spark.createDataFrame([(0, 1, 1, 1, datetime(2024, 1, 1), "view", "d", "US")], EV)  # one step only
    j = paths.build_session_journeys(ev)
    assert j.count() == 0 and "path" in j.columns
    assert paths.funnel(j).count() == 0  # empty, not three zero rows
    assert paths.top_paths(j).count() == 0
    t = paths.transition_counts(j)
    assert t.count() == 0
    assert paths.transition_matrix(t).count() == 0
    lift = paths.segment_path_lift(j, None)
    assert lift.count() == 0 and lift.columns == ["segment_id", "path", "n_sessions", "p_seg", "p_all", "lift"]


def test_single_period_has_no_drift_and_nan_summary(spark):
    ev = spark.createDataFrame([(0, 1, 1, 1, datetime(2024, 1, 1), "view", "d", "US"),
                                (1, 2, 1, 1, datetime(2024, 1, 2) + timedelta(hours=1), "view", "d", "US")], EV)
    a = spark.createDataFrame([(1, 0), (2, 1)], "user_id long, segment_id int")
    d = stability.temporal_drift(stability.segment_shares(ev, a, "M"))
    assert d.count() == 0
    summ = {r["metric"]: r["value"] for r in stability.stability_summary(d, None).collect()}
    assert all(math.isnan(v) for v in summ.values())


def test_segment_without_sessions_survives(spark):
    ev = spark.createDataFrame([(0, 1, 1, 1, datetime(2024, 1, 1), "purchase", "d", "US")], EV)
    a = spark.createDataFrame([(1, 0), (9, 1), (8, -1)], "user_id long, segment_id int")
    rows = {r["segment_id"]: r for r in conversion.segment_conversion(sessions.session_rollup(ev), a).collect()}
    assert set(rows) == {0, 1}
    assert rows[1]["n_sessions"] is None and rows[1]["conversion_leakage"] == 1.0
    assert rows[0]["conversion_efficiency"] == 0.0  # purchase without cart: atc rate 0 -> efficiency 0
