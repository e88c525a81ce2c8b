from touchline.operators import quality


def test_key_null_rates(spark):
    df = spark.createDataFrame([(1, ""), (None, "x"), (3, " "), (4, "y")], "a int, b string")
    rates = {r.column: r.null_rate for r in quality.key_null_rates(df, "t", ["a", "b", "c"]).collect()}
    assert rates == {"a": "25.00%", "b": "50.00%", "c": "column missing"}
    empty = spark.createDataFrame([], "a int")
    assert quality.key_null_rates(empty, "t", ["a"]).first().null_rate == "not computed"


def test_fk_and_labels_and_model_report(spark):
    fs = spark.createDataFrame([(1, "e1", 10, 1, 97, 40, 87), (1, "e2", 10, 2, 96, None, 87),
                                (2, "e3", 30, None, 99, 40, 87)],
                               "match_id int, event_id string, team_id int, player_id int, shot_outcome_id int, "
                               "body_part_id int, shot_type_id int")
    dm = spark.createDataFrame([(1,)], "match_id int")
    dt = spark.createDataFrame([(10, "T")], "team_id int, team_name string")
    dp = spark.createDataFrame([(1, "P")], "player_id int, player_name string")
    do = spark.createDataFrame([(97, "Goal"), (96, " ")], "shot_outcome_id int, shot_outcome_name string")
    fk = {r.check: r.violations for r in quality.fk_violations(fs, [("match_id", dm, "match_id"),
                                                                    ("team_id", dt, "team_id"),
                                                                    ("player_id", dp, "player_id")]).collect()}
    assert fk == {"fact.match_id": 1, "fact.team_id": 1, "fact.player_id": 1}
    assert quality.missing_outcome_labels(fs, do).first().missing_labels == 2
    g = quality.goal_consistency(fs, do).first()
    assert (g.goals_by_name, g.goals_by_id) == (1, 1)
    report = {r.check: r.status for r in quality.validate_model(spark, {
        "fact_shots": fs, "dim_match": dm, "dim_team": dt, "dim_player": dp, "dim_shot_outcome": do}).collect()}
    assert report["overall"] == "FAIL" and report["fk fact_shots.team_id"] == "FAIL"
    assert report["fact_shots unique (match_id, event_id)"] == "PASS"
    assert report["body_part_id populated"] == "FAIL"
    dup = {r.dim: r.duplicate_keys for r in quality.duplicate_dim_keys({"d": (dt.union(dt), "team_id")}).collect()}
    assert dup == {"d": 1}
