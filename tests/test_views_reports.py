from pyspark.sql import functions as F

from touchline.operators import reports, views

OUT = "shot_outcome_id int, shot_outcome_name string"


def _dims(spark):
    outcome = spark.createDataFrame([(97, "Goal"), (96, "Saved"), (98, "Off T"), (100, "Blocked")], OUT)
    body = spark.createDataFrame([(40, "Right Foot")], "body_part_id int, body_part_name string")
    typ = spark.createDataFrame([(87, "Open Play")], "shot_type_id int, shot_type_name string")
    team = spark.createDataFrame([(10, "Home"), (20, "Away")], "team_id int, team_name string")
    player = spark.createDataFrame([(1, "P1"), (2, "P2")], "player_id int, player_name string")
    return outcome, body, typ, team, player


def test_legacy_labels_win_unless_numeric(spark):
    outcome, body, typ, team, player = _dims(spark)
    shots = spark.createDataFrame(
        [("e1", 1, 10, 1, "97", 97, None, 87), ("e2", 1, 10, 1, "Saved", 97, "40", None),
         ("e3", 1, 20, None, None, 98, None, None)],
        "event_id string, match_id int, team_id int, player_id int, shot_outcome string, shot_outcome_id int, "
        "shot_body_part_id string, shot_type_id int")
    lab = {r.event_id: r for r in views.ensure_shot_labels(shots, outcome, body, typ).collect()}
    assert lab["e1"].shot_outcome == "Goal" and lab["e1"].shot_type == "Open Play"
    assert lab["e2"].shot_outcome == "Saved" and lab["e2"].body_part == "Right Foot"
    assert lab["e3"].shot_outcome == "Off T" and lab["e3"].body_part is None
    v = {r.event_id: r for r in views.shots_view(views.ensure_shot_labels(shots, outcome, body, typ), team,
                                                  player).collect()}
    assert v["e2"].is_goal  # outcome id 97 counts even with a different legacy label
    assert v["e3"].team_name == "Away" and v["e3"].player_name is None


def test_dedupe_shots_orders_by_clock(spark):
    df = spark.createDataFrame([(1, "a", 1, 5, "late"), (1, "a", 1, 2, "early"), (1, None, 1, 1, "n1"),
                                (1, None, 1, 0, "n0")], "match_id int, event_id string, period int, minute int, p string")
    got = sorted(r.p for r in views.dedupe_shots(df).collect())
    assert got == ["early", "n0"]


def _stats_inputs(spark):
    dm = spark.createDataFrame([(1, 10, 20, 1, 0), (2, 10, 20, 0, 0), (3, 10, None, 1, 0), (4, 10, 20, 0, 0)],
                               "match_id int, home_team_id int, away_team_id int, home_score int, away_score int")
    shots = spark.createDataFrame(
        [(1, 10, "Goal", 0.5), (1, 10, "Saved", 0.1), (1, 20, "Off T", None), (1, 20, "Blocked", 0.2),
         (2, 10, None, 0.3), (2, 20, None, 0.1)],
        "match_id int, team_id int, shot_outcome string, xg double")
    events = spark.createDataFrame(
        [(4, 10, "Shot", 16, 0.25), (4, 20, "Pass", 30, None), (4, 20, "shot ", 99, 0.05)],
        "match_id int, team_id int, type_name string, type_id int, shot_statsbomb_xg double")
    return dm, shots, events


def test_match_stats_outcomes_fallback_and_missing_ids(spark):
    dm, shots, events = _stats_inputs(spark)
    st = {r.match_id: r for r in reports.match_stats(events, shots, dm).collect()}
    m1 = st[1]
    assert (m1.shots_home, m1.shots_away, m1.goals_home, m1.goals_away) == (2, 2, 1, 0)
    assert (m1.on_target_home, m1.off_target_away, m1.blocked_away) == (2, 1, 1)
    assert (m1.xg_home, m1.xg_away) == (0.6, 0.2)
    m2 = st[2]  # no outcome labels at all -> outcome metrics null
    assert m2.shots_home == 1 and m2.goals_home is None and m2.on_target_away is None
    m3 = st[3]  # no away id: only the official score
    assert m3.goals_home == 1 and m3.shots_home is None
    m4 = st[4]  # no shot rows: shot events used
    assert (m4.shots_home, m4.shots_away, m4.xg_home) == (1, 1, 0.25)
    cons = {r.match_id: r.consistent for r in reports.goals_consistency(reports.match_stats(events, shots, dm))
            .collect()}
    assert cons[1] is True and cons[2] is False
    shares = reports.stat_bar_shares(reports.match_stats(events, shots, dm), "shots").where("match_id = 3").first()
    assert (shares.shots_home_pct, shares.shots_away_pct) == (50.0, 50.0)


def test_kpis_timeline_top_and_filters(spark):
    sv = spark.createDataFrame(
        [(1, 10, 1, "A", 5, 0.5, True, "Goal", "Open Play"), (1, 10, 2, "B", 5, None, False, None, "Penalty"),
         (1, 10, 1, "A", 7, 0.31, False, "Saved", "Free Kick"), (1, 10, 3, None, 9, 0.05, False, "Off T", None)],
        "match_id int, team_id int, player_id int, player_name string, minute int, xg double, is_goal boolean, "
        "shot_outcome string, shot_type string")
    k = reports.shot_kpis(sv, ["match_id", "team_id"]).first()
    assert (k.shots, round(k.total_xg, 2), k.goals, k.players) == (4, 0.86, 1, 3)
    out = {r.shot_outcome: r["count"] for r in reports.shot_outcome_distribution(sv, ["match_id"]).collect()}
    assert out == {"Goal": 1, "Unknown": 1, "Saved": 1, "Off T": 1}
    tl = {r.minute: round(r.cum_xg, 2) for r in reports.cumulative_xg(sv).collect()}
    assert tl == {5: 0.5, 7: 0.81, 9: 0.86}
    top = [(r.player_name, r.shots) for r in reports.top_shooters(sv, n=2).orderBy("rank").collect()]
    assert top == [("A", 2), ("B", 1)]
    assert reports.shot_filters(sv, big_chances=True).count() == 2
    assert reports.shot_filters(sv, open_play_only=True).count() == 2  # null shot type kept
    assert reports.shot_filters(sv, only_goals=True).count() == 1


def test_heatmap_and_network(spark):
    ev = spark.createDataFrame([(1, 10, 0.0, 0.0), (1, 10, 120.0, 80.0), (1, 10, 121.0, 10.0), (1, 10, 59.9, 40.0)],
                               "match_id int, team_id int, location_x double, location_y double")
    cells = {(r.bin_x, r.bin_y): r.touches for r in reports.team_heatmap(ev).collect()}
    assert cells == {(0, 0): 1, (11, 7): 1, (5, 4): 1}
    passes = spark.createDataFrame(
        [(1, 10, 1, 2, 10.0, 10.0), (1, 10, 1, 2, 20.0, 20.0), (1, 10, 2, 1, 30.0, 30.0), (1, 10, 2, 9, 30.0, 30.0),
         (1, 10, None, 1, 1.0, 1.0)],
        "match_id int, team_id int, player_id int, pass_recipient_id int, location_x double, location_y double")
    nodes = {r.player_id: r for r in reports.pass_network_nodes(passes).collect()}
    assert nodes[1].touches == 2 and nodes[1].x == 15.0 and nodes[1].node_size == 1020.0
    edges = {(r.passer, r.receiver): r.pass_count for r in reports.pass_network_edges(passes).collect()}
    assert edges == {(1, 2): 2, (2, 1): 1}  # receiver 9 never passes: edge dropped


def test_teams_and_players_for_matches(spark):
    dm = spark.createDataFrame([(1, 10, 20)], "match_id int, home_team_id int, away_team_id int")
    team = spark.createDataFrame([(10, "Home")], "team_id int, team_name string")
    ev = spark.createDataFrame([(1, 10, 5, None), (2, 30, 6, "Six"), (2, 30, 7, None)],
                               "match_id int, team_id int, player_id int, player_name string")
    teams = {(r.match_id, r.team_id): r.team_name for r in views.teams_for_matches(dm, ev, None, team).collect()}
    assert teams == {(1, 10): "Home", (1, 20): "20", (2, 30): "30"}
    player = spark.createDataFrame([(5, "Five", 10)], "player_id int, player_name string, team_id int")
    ps = {(r.match_id, r.player_id): r.player_name for r in views.players_for_matches(ev, None, player, team).collect()}
    assert ps == {(1, 5): "Five", (2, 6): "Six", (2, 7): "7"}


def test_cascading_choices_and_first_names(spark, scratch):
    from touchline.operators import views
    dm = spark.createDataFrame([(1, 7, "Z Cup", 70, "2023", 10, 20, "2023-01-01"), (2, 7, "Z Cup", 71, "2024", 20, 30, "2024-01-01"), (3, 5, "A Cup", 71, "2024", 10, 30, "2024-02-01"),
                                (4, None, None, 71, "2024", None, None, "2024-03-01")],
                               "match_id long, competition_id long, competition_name string, season_id long, season_name string, home_team_id long, away_team_id long, match_date string")
    ev = spark.createDataFrame([(1, 10, 100), (1, 20, 100), (1, None, 101), (4, 40, 102), (2, 20, None)], "match_id long, team_id long, player_id long")
    teams = spark.createDataFrame([(10, "Ten"), (20, "Twenty")], "team_id long, team_name string")
    # two names of one player: the first row of the file counts, not the smallest name
    spark.createDataFrame([(100, "Zoe", 10), (100, "Abe", 20), (101, None, 20), (101, "Bo", 20)], "player_id long, player_name string, team_id long") \
        .coalesce(1).write.parquet(f"{scratch}/players")
    players = spark.read.parquet(f"{scratch}/players")
    assert {r.player_id: r.player_name for r in views.lookup_names(players, "player_id", "player_name").collect()} == {100: "Zoe", 101: None}
    got = {tuple(r) for r in views.cascade_levels(dm, ev, None, teams, players).collect()}
    by = {level: {r for r in got if r[0] == level} for level in ("competition", "season", "match", "team", "player")}
    assert {(r[1], r[6]) for r in by["competition"]} == {(7, "Z Cup"), (5, "A Cup")}
    assert {(r[1], r[2], r[6]) for r in by["season"]} == {(7, 70, "2023"), (7, 71, "2024"), (5, 71, "2024"), (None, 71, "2024")}
    assert {r[3] for r in by["match"]} == {1, 2, 3, 4}
    assert {(r[3], r[4], r[6]) for r in by["team"]} == {(1, 10, "Ten"), (1, 20, "Twenty"), (2, 20, "Twenty"), (2, 30, "30"), (3, 10, "Ten"), (3, 30, "30")}
    assert {(r[3], r[4], r[5], r[6]) for r in by["player"]} == {(1, 10, 100, "Zoe"), (1, 20, 100, "Zoe"), (1, 20, 101, "101"), (4, 40, 102, "102")}
    chosen = views.cascade_choices(dm, 7, 70, 1, 20, ev, None, teams, players)
    assert [r.competition_name for r in chosen["competitions"].collect()] == ["A Cup", "Z Cup"]
    assert [r.season_id for r in chosen["seasons"].collect()] == [70, 71] and [r.match_id for r in chosen["matches"].collect()] == [1]
    assert [r.team_name for r in chosen["teams"].collect()] == ["Ten", "Twenty"] and [r.player_id for r in chosen["players"].collect()] == [100]
