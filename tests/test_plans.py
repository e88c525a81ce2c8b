"""Plan-shape checks: pushdown, partial top-N, shuffles (cartesian products and Python evaluation are looked for in oracle_compare)."""

import os
import re

import pytest
from pyspark.sql import functions as F

from touchline.operators import views
from touchline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")


def _plan(df) -> str:
    """Physical plan text without expression ids (``match_id#12L`` -> ``match_id``)."""
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_fact_scan_pushes_match_predicate(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").withColumnRenamed("l_orderkey", "match_id")
    plan = _plan(views.fact_scan(li, match_id=7, columns=["match_id", "l_quantity"]))
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,7)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_top_n_is_limited_before_the_shuffle(spark):
    plan = _plan(QUERIES["latest_orders_per_customer"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_possessions_never_window_a_whole_match(spark):
    plan = _plan(QUERIES["possession_labels"](spark, SF))
    assert "hashpartitioning(_match_id" in plan
    # every row-level window is keyed by (match, period, minute); only chunk summaries use match alone
    assert "windowspecdefinition(_match_id, _period, _minute," in plan


@pytest.fixture()
def without_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _saved(spark, sf_dir, scratch):
    """The projection as a table, so that scans of it can be counted."""
    from touchline.sources.fixtures import pitch_events
    pitch_events(spark, sf_dir).write.parquet(f"{scratch}/events")
    return spark.read.parquet(f"{scratch}/events")


def test_possessions_shuffle_events_once(spark, scratch, without_broadcast):
    from touchline.operators import tactical
    plan = _plan(tactical.possessions(_saved(spark, SF, scratch)))
    rows = [line for line in plan.splitlines() if "Exchange hashpartitioning(_match_id, _period, _minute" in line]
    # the rows, the same again below their summary (reused when the plan runs), and the summary; the join adds none of rows
    assert len(rows) == 3 and plan.count("SortMergeJoin [_match_id, _period, _minute]") == 1
    assert "<=>" not in plan and "coalesce(match_id, 0)" not in plan


def test_match_stats_scan_events_twice(spark, scratch, without_broadcast):
    from touchline.operators import reports
    ev = _saved(spark, SF, scratch)
    shots = ev.where("type_name = 'Shot'")
    shots.write.parquet(f"{scratch}/shots")
    dm = ev.select("match_id", "home_team_id", "away_team_id").distinct()
    dm.write.parquet(f"{scratch}/dm")
    plan = _plan(reports.match_stats(ev.withColumn("shot_outcome", F.lit("Goal")), spark.read.parquet(f"{scratch}/shots"), spark.read.parquet(f"{scratch}/dm")))
    assert plan.count("FileScan parquet") <= 4 and plan.count(f"{scratch}/events") <= 3
    assert plan.count("SortMergeJoin") == 2  # labels and matches; no aggregate joined to itself


def test_first_rows_without_sort_aggregates(spark, scratch):
    from touchline.operators import model
    ev = _saved(spark, SF, scratch).withColumn("_ord", F.col("event_index"))
    for plan in (_plan(model.dedupe_first(ev, ["match_id", "event_id"], "_ord")), _plan(views.dedupe_shots(ev))):
        assert "SortAggregate" not in plan and plan.count("Exchange") == 1 and "WindowGroupLimit" in plan
