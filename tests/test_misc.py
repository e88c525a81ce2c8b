import os

from pyspark.sql import functions as F

from raw_fixtures import write_tree
from touchline import cli
from touchline.operators import lineups, model, views
from touchline.session import scale_conf


def test_lineup_mirror_and_concat_and_notes(spark):
    pos = spark.createDataFrame([(1, 10, 5, "Alexander", "9", 60.0, 55.0), (1, 10, 6, "Bo", "?", 20.0, 10.0)],
                                "match_id int, team_id int, player_id int, player_name string, jersey_text string, "
                                "x double, y double")
    got = {r.player_id: r for r in lineups.lineup_mirror(pos).collect()}
    assert (got[5].x_mirror, got[5].y_mirror, got[5].marker_text) == (60.0, 25.0, "9")
    assert got[6].marker_text == "Bo" and got[5].short_name == "Alexander"
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, 3.0)], "id int, b double")
    u = views.concat_frames([a, None, b])
    assert sorted(u.columns) == ["a", "b", "id"] and u.count() == 2
    assert views.concat_frames([None]) is None
    grains, rels = model.model_notes(spark)
    assert grains.count() == 12 and rels.where("dimension = 'dim_match'").count() == 4
    assert {r.fact for r in rels.collect()} >= {"fact_lineups_players", "fact_three_sixty", "fact_three_sixty_freeze_frames"}


def test_scale_conf():
    conf = scale_conf(100 * 2**40, 8000)
    assert conf["spark.sql.shuffle.partitions"] == "20000"
    assert scale_conf(10 * 2**20, 8)["spark.sql.shuffle.partitions"] == "16"


def test_cli_etl_export_validate(spark, scratch, capsys):
    raw, processed, model_dir = (os.path.join(scratch, x) for x in ("raw", "processed", "model"))
    write_tree(raw)
    assert cli.main(["etl", "--input-dir", raw, "--output-dir", processed]) == 0
    assert cli.main(["export", "--input-dir", processed, "--output-dir", model_dir]) == 0
    capsys.readouterr()
    code = cli.main(["validate", "--model-dir", model_dir])
    out = capsys.readouterr().out
    assert "[PASS] fact_shots unique (match_id, event_id)" in out
    assert (code == 0) == ("[FAIL]" not in out)
    # a dimension that repeats a key breaks the model
    dim = spark.read.parquet(f"{model_dir}/dim_shot_outcome").collect()
    spark.createDataFrame(dim * 2, "shot_outcome_id long, shot_outcome_name string").write.mode("overwrite").parquet(f"{model_dir}/dim_shot_outcome")
    assert cli.main(["validate", "--model-dir", model_dir]) == 1
    assert "[FAIL] goal name/id consistency" in capsys.readouterr().out
    assert cli.main(["validate", "--model-dir", model_dir, "--match", "1001", "--team", "20", "--player", "200"]) == 0  # has no goal
