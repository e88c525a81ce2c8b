"""Pitch projection: football-shaped events derived from the driver tables.

The driver tables hold no football data, so event-based operators run on a
deterministic projection of ``events`` (one row per source event, 400 events
per match). The same SQL text is used by Spark and by the DuckDB oracle; only
the JSON accessor differs. Everything here is derived from the input table,
so work grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PROJECTION = """
with b as (select event_id, user_id, event_type, value, {K} as k,
                  cast(floor(event_id/400.0) as bigint) as match_id, event_id % 400 as n from {SRC}),
     c as (select *, 1 + cast(floor(n/200.0) as int) as period, (7*(n%200)*(n%200) + 31*(n%200)) % 900 as clk from b)
select concat('e', cast(event_id as varchar(20))) as event_id, match_id, n as event_index, period,
  45*(period-1)+cast(floor(clk/60.0) as int) as minute, cast(clk%60 as int) as second,
  match_id%20 as home_team_id, (match_id+7)%20 as away_team_id,
  case when event_id%97=0 then null
       when (cast(floor(clk/40.0) as bigint) + case when user_id%10=0 then 1 else 0 end)%2=0 then match_id%20
       else (match_id+7)%20 end as team_id,
  case when user_id%50=49 then null else user_id end as player_id,
  case when event_type='click' and user_id%3<>0 then (user_id+11)%50 end as pass_recipient_id,
  case event_type when 'click' then 30 when 'view' then 43 when 'error' then 17 when 'signup' then 4 else 16 end as type_id,
  case event_type when 'click' then 'Pass' when 'view' then 'Carry' when 'error' then 'Pressure'
                  when 'signup' then 'Duel' else 'Shot' end as type_name,
  case when k>=98 then null else cast(k as double)*1.25-1 end as location_x,
  cast((event_id*37)%83 as double)-1 as location_y,
  case when event_type='click' then cast(k as double)*1.25+value/4-8 end as pass_end_location_x,
  case when event_type='click' then cast((event_id*53)%81 as double) end as pass_end_location_y,
  case when event_type='view' then cast(k as double)*1.25+value/8 end as carry_end_location_x,
  case when event_type='view' then cast((event_id*29)%81 as double) end as carry_end_location_y,
  case when event_type='click' and event_id%4=0 then 'Incomplete'
       when event_type='click' and event_id%4=1 then '' end as pass_outcome_name,
  case when event_type='purchase' then value/500 end as shot_statsbomb_xg,
  case when event_type='purchase' and event_id%31<>0 then 96+k%7 end as shot_outcome_id,
  case when event_type='purchase' then 60+k%3 end as shot_type_id,
  case when event_type='purchase' then 37+k%4 end as body_part_id
from c
"""

SPARK_K = "cast(get_json_object(props,'$.k') as int)"
DUCKDB_K = "cast(json_extract_string(props,'$.k') as int)"

# Fixture label dimensions (ids as in the projection; goal = 97,
# outcome names as used by the match-stats outcome families).
SHOT_OUTCOMES = [(96, "Saved"), (97, "Goal"), (98, "Off T"), (99, "Post"),
                 (100, "Blocked"), (101, "Wayward"), (102, "Saved to Post")]
SHOT_TYPES = [(60, "Open Play"), (61, "Penalty"), (62, "Free Kick")]
BODY_PARTS = [(37, "Right Foot"), (38, "Left Foot"), (39, "Head")]  # 40 deliberately unlabelled


def projection_sql(engine: str) -> str:
    if engine == "spark":
        return _PROJECTION.replace("{K}", SPARK_K).replace("{SRC}", "{events}")
    return _PROJECTION.replace("{K}", DUCKDB_K).replace("{SRC}", "events")


def _values_sql(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"select * from (values {body}) as t({', '.join(cols)})"


def duckdb_prelude() -> str:
    """CTEs shared by every oracle query: pitch events + fixture dims."""
    return f"""with pitch as ({projection_sql('duckdb')}),
dim_match as (select distinct match_id, home_team_id, away_team_id, match_id % 4 as competition_id,
                     100 + match_id % 3 as season_id from pitch),
dim_team as (select distinct team_id, 'Team ' || cast(team_id as varchar) as team_name from
             (select home_team_id as team_id from pitch union select away_team_id from pitch)),
dim_player as (select distinct player_id, 'Player ' || cast(player_id as varchar) as player_name
               from pitch where player_id is not null),
dim_shot_outcome as ({_values_sql(SHOT_OUTCOMES, ['shot_outcome_id', 'shot_outcome_name'])}),
dim_shot_type as ({_values_sql(SHOT_TYPES, ['shot_type_id', 'shot_type_name'])}),
dim_body_part as ({_values_sql(BODY_PARTS, ['body_part_id', 'body_part_name'])})
"""


def oracle(body: str) -> str:
    return duckdb_prelude() + body


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a plain Parquet scan (splits follow the files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pitch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection as a lazy DataFrame over ``events.parquet``."""
    events = read_source(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    return spark.sql(projection_sql("spark"), events=events)


def pitch_dims(spark: SparkSession, pitch: DataFrame) -> dict[str, DataFrame]:
    """Fixture dimensions; match/team/player dims are derived from the events."""
    dim_match = pitch.select("match_id", "home_team_id", "away_team_id",
                             (F.col("match_id") % 4).alias("competition_id"),
                             (F.lit(100) + F.col("match_id") % 3).alias("season_id")).distinct()
    teams = (pitch.select(F.col("home_team_id").alias("team_id"))
             .union(pitch.select(F.col("away_team_id").alias("team_id"))).distinct())
    dim_team = teams.select("team_id", F.concat(F.lit("Team "), F.col("team_id").cast("string")).alias("team_name"))
    dim_player = (pitch.where(F.col("player_id").isNotNull()).select("player_id").distinct()
                  .select("player_id", F.concat(F.lit("Player "), F.col("player_id").cast("string"))
                          .alias("player_name")))

    def small(rows, id_col, name_col):
        # fixed lists of a few rows: broadcast is safe by construction
        return F.broadcast(spark.createDataFrame(rows, f"{id_col} int, {name_col} string"))

    return {
        "dim_match": dim_match,
        "dim_team": dim_team,
        "dim_player": dim_player,
        "dim_shot_outcome": small(SHOT_OUTCOMES, "shot_outcome_id", "shot_outcome_name"),
        "dim_shot_type": small(SHOT_TYPES, "shot_type_id", "shot_type_name"),
        "dim_body_part": small(BODY_PARTS, "body_part_id", "body_part_name"),
    }
