import os

import pytest
from pyspark.sql import functions as F

from raw_fixtures import write_tree
from touchline.operators import quality
from touchline.plans import etl, star_schema


def test_raw_to_star_schema_and_validation(spark, scratch):
    raw, processed, model_dir = (os.path.join(scratch, x) for x in ("raw", "processed", "model"))
    write_tree(raw)
    etl.run_etl(spark, raw, processed)
    counts = star_schema.export_star_schema(spark, processed, model_dir)
    # ev-1 appears twice in 1001.json: the first copy wins, the duplicate is dropped
    assert counts["fact_events"] == 4
    assert counts["fact_shots"] == 1
    assert counts["dim_zone"] == 30
    assert counts["dim_match"] == 2
    dm = {r.match_id: r for r in spark.read.parquet(f"{model_dir}/dim_match").collect()}
    assert dm[1001].match_label == "Home FC vs Away FC (2024-01-01)"
    assert dm[1001].is_360_available == 1 and dm[1002].is_360_available == 0
    assert dm[1001].competition_id == 2 and dm[1001].season_id == 5
    teams = {r.team_id: r.team_name for r in spark.read.parquet(f"{model_dir}/dim_team").collect()}
    # matches override the teams table; 1002 names team 20 'Away FC', team 30 stays ''
    assert teams[10] == "Home FC" and teams[20] == "Away FC" and teams[30] == ""
    shot = spark.read.parquet(f"{model_dir}/fact_shots").first()
    assert (shot.event_id, shot.shot_outcome_id, shot.body_part_id, shot.zone_id) == ("ev-2", 97, 40, 6)
    fe = spark.read.parquet(f"{model_dir}/fact_events")
    assert set(fe.select("competition_id").distinct().toPandas().competition_id) == {2}
    small = {r.type_id: r.type_name for r in spark.read.parquet(f"{model_dir}/dim_event_type").collect()}
    assert small == {30: "Pass", 16: "Shot", 17: "Pressure"}
    outcomes = {r.shot_outcome_id: r.shot_outcome_name for r in
                spark.read.parquet(f"{model_dir}/dim_shot_outcome").collect()}
    assert outcomes == {97: "Goal"}
    tables = star_schema.build_model(spark, processed)
    checks = {r.check: r.value for r in star_schema.export_checks(spark, tables).collect()}
    assert checks["no shot_outcome_name"] == 0 and checks["has shot_outcome_id"] == 0
    assert all(v == 0 for k, v in checks.items() if k.startswith("duplicate keys"))
    report = {r.check: (r.status, r.value) for r in quality.validate_model(spark, tables).collect()}
    assert report["fact_shots unique (match_id, event_id)"] == ("PASS", 0)
    assert report["goal name/id consistency"] == ("PASS", 0)
    ff = spark.read.parquet(f"{model_dir}/fact_three_sixty_freeze_frames")
    assert sorted(r.zone_id for r in ff.collect()) == [17, 17]
    f360 = spark.read.parquet(f"{model_dir}/fact_three_sixty").first()
    assert (f360.visible_area_point_count, f360.has_visible_area) == (5, 1)


def _listener_jobs(spark, action):
    """Names of the Spark jobs that ``action`` starts, by job group."""
    spark.sparkContext.setJobGroup("watched", "watched")
    try:
        result = action()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup("watched"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_broken_model_leaves_the_old_one(spark, scratch):
    facts = "event_id string, match_id long, team_id long, shot_outcome_id long, body_part_id long, shot_type_id long"
    good = {"dim_team": spark.createDataFrame([(1, "a"), (2, "b")], "team_id long, team_name string"),
            "fact_shots": spark.createDataFrame([("e1", 1, 1, 97, None, 1), ("e2", 1, 2, None, None, 2)], facts)}
    out = os.path.join(scratch, "model")
    assert star_schema.export_star_schema(spark, "", out, tables=good) == {"dim_team": 2, "fact_shots": 2}
    twice = {**good, "dim_team": spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (3, "c"), (None, "n")], "team_id long, team_name string")}
    labelled = {**good, "fact_shots": good["fact_shots"].withColumn("shot_type", F.lit("Open Play")).drop("body_part_id")}
    for tables, rules in ((twice, ["duplicate keys dim_team"]), (labelled, ["has body_part_id", "no shot_type"])):
        with pytest.raises(star_schema.ModelRejected) as rejected:
            star_schema.export_star_schema(spark, "", out, tables=tables)
        assert rejected.value.failed == rules
        assert sorted(r.team_name for r in spark.read.parquet(f"{out}/dim_team").collect()) == ["a", "b"]
        assert spark.read.parquet(f"{out}/fact_shots").columns == good["fact_shots"].columns
    assert sorted(os.listdir(out)) == ["_notes", "dim_team", "fact_shots"]
    # a later, larger model takes the place of the old one; what a dead run left is cleared away
    os.makedirs(f"{out}/_next-dead/dim_team")
    more = {**good, "dim_team": spark.createDataFrame([(i, str(i)) for i in range(9)], "team_id long, team_name string")}
    assert star_schema.export_star_schema(spark, "", out, "csv", tables=more)["dim_team"] == 9
    assert spark.read.option("header", "true").csv(f"{out}/dim_team").count() == 9
    assert sorted(os.listdir(out)) == ["_notes", "dim_team", "fact_shots"]
    assert spark.read.json(f"{out}/_notes/grains").count() == 12


def test_counts_come_from_the_write(spark, scratch):
    """Rows, null ids and repeated keys are counted once, although the sort by match samples its input."""
    facts = spark.range(1000).selectExpr("concat('e', id) as event_id", "id % 7 as match_id", "if(id % 10 = 0, null, 97L) as shot_outcome_id",
                                         "1L as body_part_id", "cast(null as string) as shot_type_id")
    seen, jobs = _listener_jobs(spark, lambda: star_schema.write_observed(facts, "fact_shots", f"{scratch}/f", "parquet"))
    assert (seen.rows, seen.null_ids, seen.repeated_keys) == (1000, {"shot_outcome_id": 100, "body_part_id": 0, "shot_type_id": 1000}, 0)
    assert jobs <= 3  # the sample of the ranges, the shuffle and the write
    assert spark.read.parquet(f"{scratch}/f").columns == facts.columns
