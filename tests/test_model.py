from pyspark.sql import functions as F

from touchline.functions.pitch import minute_absolute, time_key, zone_id
from touchline.operators import model


def test_dedupe_keeps_first_and_null_keys(spark):
    rows = [(1, "a", 2, "late"), (1, "a", 1, "early"), (1, None, 3, "n1"), (1, None, 4, "n2"), (1, " ", 5, "blank"),
            (None, "a", 6, "nomatch")]
    df = spark.createDataFrame(rows, "match_id int, event_id string, ord int, payload string")
    got = sorted(r.payload for r in model.dedupe_first(df, ["match_id", "event_id"], "ord").collect())
    assert got == ["blank", "early", "n1", "n2", "nomatch"]
    dup = model.duplicate_extra_rows(df, ["match_id", "event_id"]).first()
    assert (dup.duplicate_keys, dup.duplicate_rows) == (2, 2)  # ('1','a') and ('1', null) both twice


def test_id_name_dim_first_non_empty(spark):
    rows = [("5", "", 1), ("5", " Pass ", 2), ("5", "Other", 3), ("6", None, 1), ("x", "junk", 0), ("12.7", "T", 0)]
    df = spark.createDataFrame(rows, "type_id string, type_name string, o int")
    got = {r.type_id: r.type_name for r in model.id_name_dim(df, "type_id", "type_name", "o").collect()}
    assert got == {5: "Pass", 6: "", 12: "T"}


def test_zone_time_and_minutes(spark):
    df = spark.createDataFrame([(120.0, 80.0), (0.0, 0.0), (20.0, 16.0), (-1.0, 10.0), (10.0, 81.0), (None, 1.0)],
                               "x double, y double")
    assert [r.z for r in df.select(zone_id(F.col("x"), F.col("y")).alias("z")).collect()] == [29, 0, 7, None, None,
                                                                                            None]
    t = spark.createDataFrame([(1, 2, 3), (2, 0, 5), (None, 1, 1), (1, -50, 0)], "p int, m int, s int")
    got = t.select(time_key(F.col("p"), F.col("m"), F.col("s")).alias("k"),
                   minute_absolute(F.col("p"), F.col("m")).alias("a")).collect()
    assert [(r.k, r.a) for r in got] == [(100203, 2), (200005, 45), (None, None), (95000, 0)]


def test_dim_zone_and_dim_time(spark):
    z = {r.zone_id: r for r in model.dim_zone(spark).collect()}
    assert len(z) == 30 and z[0].zone_label == "Zone 0 (Left Wing Defensive Sixth)"
    assert (z[29].x_min, z[29].x_max, z[29].y_min, z[29].y_max) == (100, 120, 64, 80)
    ev = spark.createDataFrame([(1, 44, 59), (2, 45, 0), (3, 91, 0), (1, 44, 59), (None, 1, 1)],
                               "period int, minute int, second int")
    t = {r.time_key: r for r in model.dim_time(ev).collect()}
    assert set(t) == {104459, 204500, 309100}
    assert t[204500].minute_absolute == 90 and t[204500].time_bucket_15min == 90 and t[204500].is_second_half == 1
    assert t[309100].is_extra_time == 1


def test_shot_flag_uses_ids_seen_with_shot_name(spark):
    rows = [("e1", 1, 99, " SHOT ", 1), ("e2", 1, 99, "other", 2), ("e3", 1, 16, None, 3), ("e4", 1, 5, "Pass", 4)]
    ev = spark.createDataFrame(rows, "event_id string, match_id int, type_id int, type_name string, o int")
    got = sorted(r.event_id for r in model.fact_shots(ev, "o").collect())
    assert got == ["e1", "e2", "e3"]


def test_team_precedence(spark):
    teams = spark.createDataFrame([(1, "T1 old", 0), (1, "T1 new", 1), (2, "T2", 0), (5, "", 0)],
                                  "team_id int, team_name string, _ord int")
    matches = spark.createDataFrame([(100, 1, "", 3, "M3", 0), (101, 3, "M3 later", 4, "", 1)],
                                    "match_id int, home_team_id int, home_team_name string, away_team_id int, "
                                    "away_team_name string, _ord int")
    lineups = spark.createDataFrame([(1, "L1", 0), (4, "", 0), (4, "L4", 1), (5, "L5", 0), (6, "", 0)],
                                    "team_id int, team_name string, _ord int")
    got = {r.team_id: r.team_name for r in model.dim_team(teams, matches, lineups).collect()}
    # 1: match overrides with '' then lineup fills; 2: teams; 3: last match; 4: first non-empty lineup
    assert got == {1: "L1", 2: "T2", 3: "M3 later", 4: "L4", 5: "L5", 6: ""}


def test_player_precedence(spark):
    players = spark.createDataFrame([(1, "", None, 0), (2, "P2", 7, 0)], "player_id int, player_name string, "
                                                                         "team_id int, _ord int")
    lineups = spark.createDataFrame([(1, "", 8, 0), (1, "P1", 9, 1), (3, "P3", None, 0), (3, "", 4, 1)],
                                    "player_id int, player_name string, team_id int, _ord int")
    got = {r.player_id: (r.player_name, r.team_id) for r in model.dim_player(players, lineups).collect()}
    assert got == {1: ("P1", 8), 2: ("P2", 7), 3: ("P3", 4)}


def test_first_and_last_row_per_key(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 5)], "k int, v string, o int")
    assert {r.k: r.v for r in model.first_row_per_key(df, "k", "o").collect()} == {1: "b", 2: "c"}
    assert {r.k: r.v for r in model.last_row_per_key(df, "k", "o").collect()} == {1: "a", 2: "c"}


def test_match_label(spark):
    df = spark.createDataFrame([("A", "B", "2024-01-01"), ("", " ", "2024"), (None, "B", None)], "h string, a string, d string")
    got = [r.l for r in df.select(model.match_label(F.col("h"), F.col("a"), F.col("d")).alias("l")).collect()]
    assert got == ["A vs B (2024-01-01)", "", " vs B ()"]


def test_three_sixty_ids_fall_back_when_visible_area_is_empty(spark):
    va = spark.createDataFrame([], "match_id bigint, event_uuid string")
    ts = spark.createDataFrame([(7, "u1"), (7, "u2"), (8, "u3")], "match_id bigint, event_uuid string")
    assert sorted(r.match_id for r in model.three_sixty_match_ids(va, ts).collect()) == [7, 8]
    va2 = spark.createDataFrame([(9, "u9")], "match_id bigint, event_uuid string")
    assert [r.match_id for r in model.three_sixty_match_ids(va2, ts).collect()] == [9]
    matches = spark.createDataFrame([(7, "2024-01-01", "A", "B", "", "", 0), (8, "2024-01-02", "C", "D", "", "x", 1),
                                     (7, "2024-01-03", "A", "B", "", "", 2)],
                                    "match_id int, match_date string, home_team_name string, away_team_name string, "
                                    "match_status_360 string, last_updated_360 string, _ord int")
    dm = {r.match_id: r for r in model.dim_match(matches, "_ord", model.three_sixty_match_ids(va2, ts)).collect()}
    assert dm[7].match_date == "2024-01-03" and dm[7].is_360_available == 0  # last row wins; 9 is the 360 match
    assert dm[8].is_360_available == 1  # 360 timestamp present
