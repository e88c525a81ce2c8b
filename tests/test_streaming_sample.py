import os
import shutil

from pyspark.sql import functions as F

from raw_fixtures import write_tree
from touchline.operators import sample
from touchline.plans import etl, star_schema
from touchline.sources import json_files
from touchline.streaming.incremental import apply_batch, processor_of, stream_events, stream_files


def test_stream_events_available_now_is_idempotent(spark, scratch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    write_tree(raw, empty=False)
    paths = sorted(r.path for r in json_files.list_files(spark, raw, "events").collect())
    schema = json_files.infer_record_schema(spark, paths)
    name = "t_stream_" + os.path.basename(scratch).replace("-", "_")  # checkpoints persist in the shared dir
    q = stream_events(spark, f"{raw}/events", out, schema, query_name=name)
    q.awaitTermination(300)
    ev = spark.read.parquet(f"{out}/events")
    assert ev.count() == 5
    assert spark.read.parquet(f"{out}/_quarantine").count() == 1
    # a new file arrives: only it is processed on the next availableNow run
    shutil.copy(f"{raw}/events/1002.json", f"{raw}/events/1005.json")
    q = stream_events(spark, f"{raw}/events", out, schema, query_name=name)
    q.awaitTermination(300)
    ev = spark.read.parquet(f"{out}/events")
    assert ev.count() == 6 and ev.where("match_id = 1005").count() == 1


def test_build_sample(spark, scratch):
    raw, processed = os.path.join(scratch, "raw"), os.path.join(scratch, "processed")
    write_tree(raw)
    etl.run_etl(spark, raw, processed)
    model = star_schema.build_model(spark, processed)
    tables, manifest = sample.build_sample(spark, model, " league ", "2024", n_matches=1)
    m = manifest.first()
    assert m.n_matches == 1 and m.match_ids == [1002]  # newest match date first
    assert m.row_counts.fact_events == 1 and m.row_counts.dim_team == 2
    assert {r.team_id for r in tables["dim_team"].collect()} == {20, 30}


def _tables(spark, out):
    got = {}
    for name in ("events", "competitions", "matches", "lineups_players", "three_sixty", "three_sixty_freeze_frames", "three_sixty_visible_area", "teams", "players"):
        df = spark.read.parquet(f"{out}/{name}")
        df = df.select(*sorted(c for c in df.columns if c != "_bucket"))
        got[name] = sorted(str(r.asDict(recursive=True)) for r in df.collect())
    return got


def test_streamed_files_and_replays_equal_a_batch_run(spark, scratch):
    raw, batch_out, out = (os.path.join(scratch, x) for x in ("raw", "batch", "out"))
    write_tree(raw, empty=False)
    with open(f"{raw}/lineups/1002.json", "w") as f:  # names player 201 anew, and a team that a match calls something else
        f.write('[{"team_id": 20, "team_name": "Late FC", "lineup": [{"player_id": 201, "player_name": "Renamed"}]}]')
    with open(f"{raw}/three-sixty/1002.json", "w") as f:
        f.write('[{"id": "ev-7", "freeze_frame": [{"player_id": 100, "location": [1, 2]}, {"player_id": 999}]}]')
    etl.run_etl(spark, raw, batch_out)
    want = _tables(spark, batch_out)
    assert any("Late FC" in r for r in want["teams"]) and any("999" in r for r in want["players"])
    # batches in an order that is not that of the processors; the last one is replayed, as after a failure
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(raw).select(F.col("_metadata.file_path").alias("_file"), "value")
    split = [files.where(F.col("_file").rlike("lineups/1002|three-sixty|competitions")), files.where(~F.col("_file").rlike("lineups/1002|three-sixty|competitions"))]
    proc = processor_of(F.col("_file"), raw)
    for batch_id, part in ((0, split[0]), (1, split[1]), (1, split[1])):
        apply_batch(part, batch_id, out, proc)
    assert _tables(spark, out) == want
    assert spark.read.parquet(f"{out}/_quarantine").count() == 1


def test_stream_of_all_processors(spark, scratch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    write_tree(raw, empty=False)
    stream_files(spark, raw, out, query_name="t_all_" + os.path.basename(scratch).replace("-", "_")).awaitTermination(300)
    assert spark.read.parquet(f"{out}/events").count() == 5 and spark.read.parquet(f"{out}/matches").count() == 2
    assert {r.team_id: r.team_name for r in spark.read.parquet(f"{out}/teams").collect()} == {10: "Home FC", 20: "Away FC", 30: ""}
