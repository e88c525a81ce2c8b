import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raw_fixtures import write_tree
from touchline.plans import etl
from touchline.sources import json_files


def test_read_records_positions_bom_single_object_and_quarantine(spark, scratch):
    write_tree(scratch, bom=True)
    files = json_files.list_files(spark, scratch, "events")
    paths = sorted(r.path for r in files.collect())
    assert [p.rsplit("/", 1)[1] for p in paths] == ["1001.json", "1002.json", "1003.json"]  # 0-byte not listed
    recs, quarantine = json_files.read_records(spark, paths, processor="events")
    got = sorted((r["_file"].rsplit("/", 1)[1], r["_pos"], r["id"]) for r in recs.collect())
    assert got == [("1001.json", 0, "ev-1"), ("1001.json", 1, "ev-2"), ("1001.json", 2, "ev-3"),
                   ("1001.json", 3, "ev-1"), ("1002.json", 0, "ev-7")]
    assert [r.path.rsplit("/", 1)[1] for r in quarantine.collect()] == ["1003.json"]


def test_events_table_flatten_and_match_id(spark, scratch):
    from touchline.operators import ingest
    write_tree(scratch)
    paths = sorted(r.path for r in json_files.list_files(spark, scratch, "events").collect())
    recs, _ = json_files.read_records(spark, paths, processor="events")
    ev = ingest.events_table(recs)
    cols = ev.columns
    for c in ("event_id", "event_index", "match_id", "type_id", "type_name", "location_x", "location_y",
              "pass_end_location_x", "shot_end_location_z", "shot_statsbomb_xg", "pass_recipient_id"):
        assert c in cols, c
    row = ev.where(F.col("event_id") == "ev-2").first()
    assert row.match_id == 1001 and row.type_id == 16 and row.shot_end_location_z == 1.0
    assert json.loads(row.location) == [12.0, 20.0] and row.location_x == 12.0


def test_non_numeric_event_file_name_fails(spark, scratch):
    from touchline.operators import ingest
    write_tree(scratch, corrupt=False, empty=False, bad_name=True)
    paths = sorted(r.path for r in json_files.list_files(spark, scratch, "events").collect())
    recs, _ = json_files.read_records(spark, paths, processor="events")
    with pytest.raises(Exception, match="not named by a match id"):
        ingest.events_table(recs).collect()


def test_etl_end_to_end_incremental_idempotent(spark, scratch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    write_tree(raw)
    r1 = etl.run_etl(spark, raw, out)
    assert r1.processed_files["events"] == 3
    ev = spark.read.parquet(f"{out}/events")
    assert ev.count() == 5
    lu = spark.read.parquet(f"{out}/lineups_players").orderBy("player_id").collect()
    assert [(r.player_id, r.starter, r.position_name) for r in lu] == [(100, True, "Goalkeeper"),
                                                                       (101, False, "Center Forward")]
    vis = spark.read.parquet(f"{out}/three_sixty_visible_area").first()
    assert vis.visible_area_point_count == 5
    assert spark.read.parquet(f"{out}/three_sixty_freeze_frames").count() == 2
    teams = {r.team_id: r.team_name for r in spark.read.parquet(f"{out}/teams").collect()}
    assert teams[10] == "Home FC" and teams[30] == ""
    # second run: nothing changed except the corrupt file, which is retried
    r2 = etl.run_etl(spark, raw, out)
    assert r2.processed_files["events"] == 1 and r2.processed_files["matches"] == 0
    assert spark.read.parquet(f"{out}/events").count() == 5
    # a changed file replaces its own partition: no duplicates
    with open(f"{raw}/events/1002.json", "w") as f:
        f.write('[{"id": "ev-8", "index": 1, "minute": 3, "second": 0, "type": {"id": 30, "name": "Pass"}}]')
    os.utime(f"{raw}/events/1002.json", (2_000_000_000, 2_000_000_000))
    r3 = etl.run_etl(spark, raw, out)
    assert r3.processed_files["events"] == 2
    ev = spark.read.parquet(f"{out}/events")
    assert sorted(r.event_id for r in ev.where("match_id = 1002").collect()) == ["ev-8"]
    assert ev.count() == 5
    files = spark.read.parquet(f"{out}/_quality/files").where(F.col("run_id") == r1.run_id)
    ev_files = files.where("processor = 'events'").first()
    assert (ev_files.found, ev_files.processed, ev_files.failed) == (4, 4, 2)  # with the 0-byte file
    md = etl.quality_report_markdown(spark, out, r1.run_id)
    assert "Key null rates" in md


def test_etl_full_rebuild(spark, scratch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    write_tree(raw)
    etl.run_etl(spark, raw, out, incremental=False, include={"events"})
    etl.run_etl(spark, raw, out, incremental=False, include={"events"})
    ev = spark.read.parquet(f"{out}/events")
    assert ev.count() == 5 and ev.select("match_id").distinct().count() == 2
    players = {r.player_id: r.player_name for r in spark.read.parquet(f"{out}/players").collect()}
    assert players[101] == "Player 101" and players[201] == "Player 201"


def put(root, name, value):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))
    put.clock += 10
    os.utime(path, (put.clock, put.clock))


put.clock = 1_900_000_000
EVENT = {"id": "e", "minute": 1, "second": 2, "type": {"id": 1, "name": "T"}, "team": {"id": 5, "name": "A"}, "player": {"id": 7, "name": "P"}}


def lineup(team, players):
    return {"team_id": team, "team_name": f"T{team}", "lineup": [{"player_id": p, "player_name": f"P{p}", "jersey_number": 1, "positions": []} for p in players]}


def test_two_files_of_one_match_keep_their_rows(spark, scratch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    put(raw, "lineups/a/7.json", [lineup(1, [10])])
    put(raw, "lineups/b/7.json", [lineup(2, [20]), lineup(3, [])])
    put(raw, "lineups/x.json", [lineup(4, [40])])
    put(raw, "lineups/y.json", [lineup(5, [50])])
    etl.run_etl(spark, raw, out)
    put(raw, "lineups/a/7.json", [lineup(1, [11, 12])])
    put(raw, "lineups/y.json", [lineup(5, [51])])
    etl.run_etl(spark, raw, out)
    got = spark.read.parquet(f"{out}/lineups_players")
    assert sorted(r.player_id for r in got.collect()) == [11, 12, 20, 40, 51]
    # position lists are all empty, and a team without players is a team
    assert {r.team_id for r in spark.read.parquet(f"{out}/teams").collect()} == {1, 2, 3, 4, 5}
    put(raw, "lineups/a/7.json", [])
    etl.run_etl(spark, raw, out)
    assert sorted(r.player_id for r in spark.read.parquet(f"{out}/lineups_players").collect()) == [20, 40, 51]


def test_types_that_drift_between_runs(spark, scratch):
    from touchline.sources.tables import read_table
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    put(raw, "events/1.json", [EVENT | {"duration": 1, "flag": True}])
    etl.run_etl(spark, raw, out)
    put(raw, "events/2.json", [EVENT | {"duration": 1.5, "flag": "x", "more": [1]}])
    etl.run_etl(spark, raw, out)
    got = {r.match_id: (r.duration, r.flag, r.more) for r in read_table(spark, out, "events").collect()}
    assert got == {1: ("1", "true", None), 2: ("1.5", "x", "[1]")}


def test_mixed_lists_and_broken_objects(spark, scratch):
    put(scratch, "events/1.json", '[{"id": "a", "minute": 1}, 3, "x", null, {"id": "b"}]')
    put(scratch, "events/2.json", '{"id": "x", "minute": tru}')
    put(scratch, "events/3.json", "[1, 2")
    put(scratch, "events/4.json", "7")
    paths = [r.path for r in json_files.list_files(spark, scratch, "events").collect()]
    recs, quarantine = json_files.read_records(spark, paths)
    assert sorted((r._pos, r.id) for r in recs.collect()) == [(0, "a"), (4, "b")]
    assert sorted(r.path[-6:] for r in quarantine.collect()) == ["2.json", "3.json", "4.json"]


def test_full_rebuild_over_a_corrupt_file_drops_old_rows(spark, scratch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    put(raw, "events/1.json", [EVENT])
    etl.run_etl(spark, raw, out)
    put(raw, "events/1.json", "[{")
    etl.run_etl(spark, raw, out, incremental=False)
    from touchline.sources.tables import read_table
    assert read_table(spark, out, "events") is None


def test_empty_events_folder_does_not_fall_back(spark, scratch):
    os.makedirs(f"{scratch}/events")
    put(scratch, "competitions.json", [{"competition_id": 1}])
    assert json_files.list_files(spark, scratch, "events").count() == 0
    assert etl.run_etl(spark, scratch, f"{scratch}/out").processed_files == {"events": 0, "competitions": 1, "matches": 0, "lineups": 0, "three-sixty": 0}


def test_three_sixty_without_frames(spark, scratch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    put(raw, "three-sixty/1.json", [{"event_uuid": "u", "visible_area": [1, 2]}])
    etl.run_etl(spark, raw, out)
    assert spark.read.parquet(f"{out}/three_sixty").count() == 1
    assert json.loads(spark.read.parquet(f"{out}/three_sixty_visible_area").first().visible_area) == [1.0, 2.0]


def test_manifest_comes_after_the_dims(spark, scratch, monkeypatch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    put(raw, "events/1.json", [EVENT])

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(etl, "_rebuild_dims", dies)
        with pytest.raises(RuntimeError):
            etl.run_etl(spark, raw, out)
    assert etl.run_etl(spark, raw, out).processed_files["events"] == 1
    assert spark.read.parquet(f"{out}/teams").first().team_id == 5 and spark.read.parquet(f"{out}/events").count() == 1


def test_fingerprint_by_content(spark, scratch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    put(raw, "events/1.json", [EVENT])
    etl.run_etl(spark, raw, out, by_content=True)
    os.utime(f"{raw}/events/1.json", (2_100_000_000, 2_100_000_000))
    assert etl.run_etl(spark, raw, out, by_content=True).processed_files["events"] == 0
    put(raw, "events/1.json", [EVENT | {"id": "f"}])
    os.utime(f"{raw}/events/1.json", (2_100_000_000, 2_100_000_000))
    assert etl.run_etl(spark, raw, out, by_content=True).processed_files["events"] == 1


def test_changed_file_with_an_old_time_is_seen_by_content(spark, scratch, monkeypatch):
    """Also in several reads, none of which holds all names or rewrites the rows of another."""
    monkeypatch.setattr(etl, "FILES_A_READ", 2)
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    for i in range(1, 6):
        put(raw, f"events/{i}.json", [EVENT | {"id": f"e{i}"}])
        os.utime(f"{raw}/events/{i}.json", (1_000_000, 1_000_000))
    assert etl.file_groups(5) == 3
    etl.run_etl(spark, raw, out, by_content=True, include={"events"})
    put(raw, "events/3.json", [EVENT | {"id": "xx"}])  # same size and time, other content
    os.utime(f"{raw}/events/3.json", (1_000_000, 1_000_000))
    assert etl.run_etl(spark, raw, out, include={"events"}).processed_files["events"] == 0
    assert etl.run_etl(spark, raw, out, by_content=True, include={"events"}).processed_files["events"] == 1
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/events").collect()) == ["e1", "e2", "e4", "e5", "xx"]


def test_strict_json_include_and_max_files(spark, scratch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    write_tree(raw)
    with pytest.raises(ValueError, match="Failed to parse JSON"):
        etl.run_etl(spark, raw, os.path.join(scratch, "strict"), include={"events"}, strict_json=True)
    r = etl.run_etl(spark, raw, out, include={"matches", "competitions"})
    assert set(r.processed_files) == {"matches", "competitions"}
    assert spark.read.parquet(f"{out}/matches").count() == 2
    listing = json_files.list_files(spark, raw, "events", max_files=1).collect()
    assert [p.path.rsplit("/", 1)[1] for p in listing] == ["1001.json"]
    r2 = etl.run_etl(spark, raw, out, exclude={"events", "lineups", "three-sixty"})
    assert r2.processed_files == {"competitions": 0, "matches": 0}  # unchanged files are skipped
    r3 = etl.run_etl(spark, raw, out, include={"matches"}, force=True)
    assert r3.processed_files == {"matches": 1}


def test_whole_files_are_strict_and_elements_are_not(spark):
    from touchline.sources.json_files import elements
    good = {"list": ('[{"a":1,"b":[1,2.5]}, 5, null, {"a":"x"}, [1], "s", "{\\"x\\":1}"]', [0, 3]), "none": ("[]", []), "one": (' {"a":1}\r\n', [0]),
            "bom": ("\ufeff[{}]", [0]), "nan": ('[{"a":NaN}]', [0]), "nulls": ("[null]", [])}
    bad = ['[{"a":1}, {"a":', '[{"a":1}] trailing', '[{"a":1}][2]', '[1]]', '{"a":1}{"b":2}', '{"a":{"b":1}', '"x"', "5", "null", "", "[{\"a\" 1}]", "{"]
    raw = spark.createDataFrame([(k, t) for k, (t, _) in good.items()] + [(f"bad{i}", t) for i, t in enumerate(bad)], "_file string, value string")
    found, quarantine = elements(raw)
    got = {}
    for r in found.collect():
        got.setdefault(r._file, []).append(r._pos)
    assert got == {k: p for k, (_, p) in good.items() if p}
    assert sorted(r.path for r in quarantine.collect()) == sorted(f"bad{i}" for i in range(len(bad)))


def test_files_above_the_variant_limit(spark, scratch):
    """A list of 140 MB, more than one variant may hold, gives all its objects; a broken one none."""
    from touchline.sources.json_files import read_records
    item = '{"id":%d,"v":"' + "x" * 14_000 + '"}'
    text = "[" + ",".join(item % i for i in range(10_000)) + "]"
    for name, body in (("1.json", text), ("2.json", text[:-1])):
        with open(f"{scratch}/{name}", "w") as f:
            f.write(body)
    try:
        records, quarantine = read_records(spark, [f"{scratch}/1.json", f"{scratch}/2.json"])
        assert records.agg(F.count("*"), F.sum("id"), F.max("_pos"), F.min(F.length("v"))).first()[:] == (10_000, 49_995_000, 9_999, 14_000)
        assert [r.path[-6:] for r in quarantine.collect()] == ["2.json"]
    finally:
        for name in ("1.json", "2.json"):
            os.remove(f"{scratch}/{name}")


def test_documents_and_records_are_parsed_once(spark):
    docs = spark.createDataFrame([("/r/lineups/1.json", [(1, "a"), (None, "b")]), ("/r/lineups/2.json", []), ("/r/lineups/3.json", None)],
                                 "_file string, items array<struct<team_id: int, team_name: string>>")
    raw = docs.select("_file", F.to_json("items").alias("value"))
    schema = T._parse_datatype_string("team_id string, team_name string, lineup array<string>")
    records, quarantine = json_files.parse_whole_files(raw, schema, "lineups")
    named = records.where("team_id is not null").select("_file", "_pos", F.length("team_id").alias("n"), F.upper("team_name").alias("name"))
    assert [tuple(r) for r in named.collect()] == [("/r/lineups/1.json", 0, 1, "A")]
    assert [r["path"] for r in quarantine.collect()] == ["/r/lineups/3.json"]
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    # the document is written once, its list parsed once; each element is written once and read as a record once
    assert plan.count("from_json(ArrayType(VariantType") == 1
    assert plan.count("StructsToJsonEvaluator") == 2
    assert plan.count("from_json(StructField(team_id") == 1
    assert quarantine._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator") == 1
