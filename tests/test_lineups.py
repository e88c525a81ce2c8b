from pyspark.sql import functions as F

from touchline.operators import lineups


def _events(spark):
    rows = [(1, 10, "Team A", "Starting XI", 0, 0, 0, None, None, None),
            (1, 20, "Team B", "Starting XI", 1, 0, 0, None, None, None)]
    pos = {1: "Goalkeeper", 2: "Right Center Back", 3: "Center Forward", 4: "Mystery Role"}
    for i in range(1, 16):
        rows.append((1, 10, "Team A", "Pass", 1 + i, 1, i, i, f"Player {i}", pos.get(i, "Center Midfield")))
    schema = ("match_id int, team_id int, team_name string, type_name string, event_index int, minute int, "
              "second int, player_id int, player_name string, position_name string")
    return spark.createDataFrame(rows, schema)


def test_xi_from_events_positions_and_unmapped(spark):
    ev = _events(spark)
    xi = lineups.starting_xi(ev)
    team_a = xi.where("team_id = 10").orderBy("sort_order").collect()
    assert 1 <= len(team_a) <= 11 and [r.player_id for r in team_a] == list(range(1, 12))
    dm = spark.createDataFrame([(1, 10, 20)], "match_id int, home_team_id int, away_team_id int")
    pos = {r.position_name: r for r in lineups.starting_positions(xi, dm).collect()}
    assert pos["Center Forward"].y > pos["Right Center Back"].y
    assert pos["Goalkeeper"].y < 50 and pos["Mystery Role"].approximate
    away = xi.where("team_id = 10").withColumn("team_id", F.lit(20))
    away_pos = {r.position_name: r for r in lineups.starting_positions(away, dm).collect()}
    assert away_pos["Goalkeeper"].y > 50
    assert [r.position_name for r in lineups.unmapped_positions(xi).collect()] == ["Mystery Role"]
    warn = lineups.xi_warnings(xi).where("team_id = 10").first()
    assert warn.players == 11 and not warn.size_warning and not warn.duplicate_names


def test_greedy_pick_is_not_two_independent_filters(spark):
    # (1,A) taken; (2,A) skipped on the name; (2,C) taken: id 2 was never taken
    rows = [(1, 10, 1, "A", 1), (1, 10, 2, "A", 2), (1, 10, 2, "C", 3)]
    ev = spark.createDataFrame(rows, "match_id int, team_id int, player_id int, player_name string, event_index int")
    got = [(r.player_id, r.player_name) for r in lineups.xi_from_events(ev).orderBy("sort_order").collect()]
    assert got == [(1, "A"), (2, "C")]


def test_xi_from_lineup_documents(spark):
    seg = "struct<position_id:int,position:string,from:string,to:string,start_reason:string>"
    schema = (f"match_id int, team_id int, team_name string, lineup array<struct<player_id:int,player_name:string,"
              f"jersey_number:int,positions:array<{seg}>>>")
    starter = [(1, "Goalkeeper", "00:00", None, "Starting XI")]
    late = [(22, "Center Forward", "60:00", None, "Substitution - On")]
    two_spells = [(9, "Right Wing", "45:00", None, "Tactical Shift"), (10, "Left Wing", "10:00", None, "Starting XI")]
    docs = spark.createDataFrame([(1, 10, "A", [(100, "Keeper", 1, starter), (101, "Sub", 12, late),
                                                (102, "Winger", 7, two_spells)])], schema)
    xi = {r.player_id: r for r in lineups.starting_xi(spark.createDataFrame(
        [], "match_id int, team_id int, player_id int, event_index int"), docs).collect()}
    assert set(xi) == {100, 102}
    assert xi[102].position_name == "Left Wing"  # earliest Starting XI segment


def test_formation_and_clock_and_mirror(spark):
    from touchline.functions.pitch import clock_seconds, formation_text
    df = spark.createDataFrame([("433", "01:30"), ("4-2-3-1", "1:02:03"), ("abc", ""), ("12", "x:1")],
                               "f string, c string")
    got = df.select(formation_text(F.col("f")).alias("f"), clock_seconds(F.col("c")).alias("c")).collect()
    assert [(r.f, r.c) for r in got] == [("4-3-3", 90), ("4-2-3-1", 3723), (None, 10**9), (None, 10**9)]
    ev = spark.createDataFrame([(1, 10, "Starting XI", 0, "442", None), (1, 10, "Starting XI", 5, None, "3-5-2")],
                               "match_id int, team_id int, type_name string, event_index int, "
                               "tactics_formation string, formation string")
    assert lineups.formations(ev).first().formation == "4-4-2"


def test_first_eleven_against_a_loop(spark, monkeypatch):
    import random
    monkeypatch.setattr(lineups, "XI_SIZE", 4)  # so that the bounds on pairs bite
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        pid = rnd.choice([None] + [1] * 30 + list(range(1, 25)))
        name = rnd.choice(["", "h"] + ["A"] * 40 + [f"N{k}" for k in range(40)])
        rows.append((1, rnd.randint(1, 40), pid, name, i))
    ev = spark.createDataFrame(rows, "match_id int, team_id int, player_id int, player_name string, event_index int")
    got = sorted((r.team_id, r.sort_order, -1 if r.player_id is None else r.player_id, r.player_name)
                 for r in lineups.xi_from_events(ev).collect())
    want = []
    for team in range(1, 41):
        ids, names, n = set(), set(), 0
        for _, t, pid, name, _ in rows:
            if t != team or n == 4 or not name or pid in ids or name.lower() in names:
                continue
            n += 1
            ids |= {pid} - {None}
            names.add(name.lower())
            want.append((team, n, -1 if pid is None else pid, name))
    assert got == sorted(want)


def test_entry_by_id_then_name_then_alone(spark):
    """First entry of the best way; numbers are given before repeated players go."""
    seg = "struct<position_id:string,position:string,from:string,to:string,start_reason:string>"
    schema = (f"match_id long, team_id long, team_name string, lineup array<struct<player_id:string,player_name:string,"
              f"jersey_number:string,positions:array<{seg}>>>, _file string, _pos int, _rank int")
    start = [("1", "Goalkeeper", "00:00", None, "Starting XI")]

    def entry(match, pos, team, name, *players, positions=start):
        return (match, team, name, [None if p is None else (str(p), f"P{p}", "7", positions) for p in players], "f", pos, 3)

    docs = spark.createDataFrame([
        entry(1, 1, 10, "x", 11), entry(1, 0, 10, "B", 12, 13), entry(1, 2, 99, " b ", 14),  # two of one id: the first; B by name, first again
        entry(2, 0, 98, "nobody", 21, None, 22, 21, 23),                                     # alone: serves both teams
        entry(3, 0, 98, "nobody", 31), entry(3, 1, 97, None, 32),                            # two strangers: no team is served
        entry(4, 0, 10, "A", *range(40, 55), positions=[]), entry(4, 1, 20, "B", positions=[])], schema)
    teams = spark.createDataFrame([(m, t, n) for m in (1, 2, 3, 4) for t, n in ((10, "A"), (20, "b"))], "match_id long, team_id long, team_name string")
    got = {}
    for r in lineups.xi_from_lineups(docs, teams).orderBy("match_id", "team_id", "sort_order").collect():
        got.setdefault((r.match_id, r.team_id, r.entry_way), []).append((r.player_id, r.sort_order))
    assert got == {(1, 10, lineups.BY_ID): [(12, 1), (13, 2)], (1, 20, lineups.BY_NAME): [(12, 1), (13, 2)],
                   (2, 10, lineups.SOLE): [(21, 1), (22, 2), (23, 4)], (2, 20, lineups.SOLE): [(21, 1), (22, 2), (23, 4)],
                   (4, 10, lineups.BY_ID): [(40 + i, i + 1) for i in range(11)]}
    # teams that get nothing from the documents (an empty lineup too) use events
    events = spark.createDataFrame([(4, 20, "b", 77, "Q", 1), (3, 10, "A", 78, "R", 1), (1, 10, "A", 79, "S", 1)],
                                   "match_id long, team_id long, team_name string, player_id long, player_name string, event_index int")
    sources = {(r.match_id, r.team_id): r.source for r in lineups.starting_xi(events, docs, teams).collect()}
    assert sources[4, 20] == sources[3, 10] == "events_fallback" and sources[1, 10] == "data_raw_lineups"
