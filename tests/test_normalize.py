from pyspark.sql import functions as F

from touchline.operators import normalize

SCHEMA = "match_id string, team_id string, location_x string, location_y string, " \
         "pass_end_location_x string, pass_end_location_y string"


def test_home_and_away_orientation(spark):
    ev = spark.createDataFrame([("1", "100", "30", "40", "90", "40"), ("1", "200", "90", "40", "30", "40")], SCHEMA)
    dm = spark.createDataFrame([(1, 100)], "match_id int, home_team_id int")
    out = normalize.normalize_event_coordinates(ev, dm).orderBy("team_id").collect()
    assert out[0].location_x == 25.0 and out[1].location_x == 25.0
    assert out[0].pass_end_location_x == 75.0 and out[1].pass_end_location_x == 75.0
    assert out[0].location_y == 50.0


def test_clamping_and_no_bound_issues(spark):
    ev = spark.createDataFrame([("1", "100", "-5", "85", "130", "-3")], SCHEMA)
    dm = spark.createDataFrame([(1, 100)], "match_id int, home_team_id int")
    out = normalize.normalize_event_coordinates(ev, dm)
    r = out.first()
    assert (r.location_x, r.location_y, r.pass_end_location_x, r.pass_end_location_y) == (0.0, 100.0, 100.0, 0.0)
    assert normalize.coordinate_bound_issues(out).count() == 0


def test_null_team_never_flipped_and_text_ids(spark):
    ev = spark.createDataFrame([("1", None, "30", "40", None, None), ("1", " 200 ", "abc", "nan", "", None)], SCHEMA)
    dm = spark.createDataFrame([(1, 100)], "match_id int, home_team_id int")
    out = normalize.normalize_event_coordinates(ev, dm).collect()
    got = sorted((r.location_x, r.location_y) for r in out if r.location_x is not None)
    assert got == [(25.0, 50.0)]
    assert all(r.location_y is None for r in out if r.location_x is None)


def test_bounds_report_rows(spark):
    ev = spark.createDataFrame([("1", "e1", 101.5, -0.5), ("1", "e2", 50.0, 50.0)],
                               "match_id string, event_id string, location_x double, location_y double")
    issues = {(r.event_id, r.column_name): r.issue for r in normalize.coordinate_bound_issues(ev).collect()}
    assert issues == {("e1", "location_x"): "location_x out of bounds (101.5)",
                      ("e1", "location_y"): "location_y out of bounds (-0.5)"}


def test_away_shots_mirrored(spark):
    shots = spark.createDataFrame([(1, 20, 100.0, 30.0), (1, 10, 100.0, 30.0)],
                                  "match_id int, team_id int, x double, y double")
    dm = spark.createDataFrame([(1, 10, 20)], "match_id int, home_team_id int, away_team_id int")
    got = {r.team_id: (r.x, r.y) for r in normalize.orient_shots_to_home(shots, dm).collect()}
    assert got == {20: (20.0, 50.0), 10: (100.0, 30.0)}
