"""Every registered query with an oracle equals its DuckDB SQL on sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert res["ok"], res["note"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["segment_id", "n_users"]
    assert df.count() >= 0
