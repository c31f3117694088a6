"""Driver contract: bench.py prints one JSON line; the entry module exposes matching registries."""

import json
import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registries_line_up():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    from sessionlens.plans import catalog, oracle

    rows_only = set(catalog.queries()) - set(oracle.oracle_sql())
    assert rows_only == {"pipeline_run"}
    assert all(callable(f) for f in q.values())


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_REPS="1", BENCH_CPUS="2",
               BENCH_QUERIES="events_dedup,funnel")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], capture_output=True, text=True,
                         env=env, timeout=600, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    rec = json.loads(out[0])
    assert rec["unit"] == "sec" and set(rec["queries"]) == {"events_dedup", "funnel"}
    assert rec["value"] > 0 and rec["sf"] == 0.001
