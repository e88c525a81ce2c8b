"""Contract checks and the Spark-vs-DuckDB oracle for every registered query."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_mod  # noqa: E402
from oracle_compare import compare  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["match_id", "possession_id", "team_id"]


def test_every_oracle_has_a_query():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_all_queries_match_oracle(spark):
    """Also: no query's plan has a node of BAD_NODES."""
    res = compare(spark, SF, verbose=False)
    bad = {k: v for k, v in res.items() if v.get("ok") is False}
    assert not bad, bad
