"""Raw documents derived from the pitch projection: whole JSON files, one row each, as the
text source gives them (``_file, value``).

The rows that go into the documents are plain SQL over ``pitch``, used by Spark and by the
DuckDB oracles alike; only Spark nests them into documents and turns these into JSON text.
The oracles work on the rows, so parsing, flattening and the rules after it are compared
with something that never saw a document. All of it grows with the ``events`` table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from touchline.sources.fixtures import projection_sql, read_source

def each(sql: str, engine: str) -> str:
    """``EACH(a, b)`` in a select list: the row once for each value."""
    return re.sub(r"EACH\(([^)]*)\)", r"explode(array(\1))" if engine == "spark" else r"unnest([\1])", sql)


#: Lineups. Entries of a match by match_id modulo 5: 0 right ids, 1 wrong ids but right names (in
#: capitals, with blanks), 2 a single entry with neither, 3 the home team twice (with both teams'
#: players), 4 no ids, a name for the home team only. Players have none to three position segments;
#: every seventh match has no starter; some players are listed twice, some have no name.
LINEUP_ROWS = """
, squad as (select match_id, team_id, player_id,
      row_number() over (partition by match_id, team_id order by min(event_index), player_id) - 1 as pos
    from pitch where team_id is not null and player_id is not null and player_id % 9 < 4 group by match_id, team_id, player_id),
sides as (select match_id, side, home_team_id, case when side = 0 then home_team_id else away_team_id end as src
    from (select *, EACH(0, 1) as side from (select distinct match_id, home_team_id, away_team_id from pitch) m) s),
entry as (select match_id, src,
      case when match_id % 5 = 3 then side when match_id % 2 = 0 then side else 1 - side end as entry_pos,
      case when match_id % 5 = 0 then src when match_id % 5 = 3 then home_team_id when match_id % 5 = 4 then null else src + 1000 end as team_id,
      case when match_id % 5 = 1 then concat('  TEAM ', cast(src as varchar(20)), ' ')
           when match_id % 5 = 4 and side = 0 then concat('team ', cast(src as varchar(20))) when match_id % 5 = 4 then null else 'Other' end as team_name
    from sides where match_id % 5 <> 2 or side = 0),
listed as (select *, EACH(0, 1) as copy from squad),
member as (select e.match_id, e.entry_pos, s.pos + 1000 * s.copy as pos, s.player_id,
      case when s.player_id % 11 <> 0 then concat('Player ', cast(s.player_id as varchar(20))) end as player_name,
      cast(s.player_id % 99 as varchar(20)) as jersey_number
    from entry e join listed s on s.match_id = e.match_id and s.team_id = e.src where s.copy = 0 or s.player_id % 5 = 0),
segment as (select match_id, entry_pos, pos, seg, cast((player_id + seg) % 25 + 1 as varchar(20)) as position_id,
      case (player_id + seg) % 4 when 0 then 'Goalkeeper' when 1 then 'Left Back' when 2 then 'Center Forward' else 'Right Wing' end as position_name,
      case when match_id % 7 = 6 then '50:00' when (player_id * 7 + seg * 13) % 6 = 0 then '00:00' when (player_id * 7 + seg * 13) % 6 = 1 then '45:30'
           when (player_id * 7 + seg * 13) % 6 = 2 then '1:02:03' when (player_id * 7 + seg * 13) % 6 = 3 then null
           when (player_id * 7 + seg * 13) % 6 = 4 then 'late' else concat(cast((player_id * 3 + seg * 17) % 60 as varchar(20)), ':05') end as clock_from,
      case when seg = 0 and player_id % 3 = 0 then '60:00' end as clock_to,
      case when match_id % 7 = 6 then 'Substitution - On (Tactical)' when (player_id + seg + match_id) % 4 = 0 then 'Starting XI'
           when (player_id + seg + match_id) % 4 = 1 then ' starting xi' else 'Tactical Shift' end as start_reason
    from (select *, EACH(0, 1, 2) as seg from member) k where seg < (player_id + 2 * match_id) % 4)
"""

#: Seconds of a segment's clock, as the rows have it (oracles only).
SEGMENT_SECONDS = """case when clock_from in ('00:00', '45:30', '50:00', '60:00') or clock_from like '%:05'
  then cast(split_part(clock_from, ':', 1) as bigint) * 60 + cast(split_part(clock_from, ':', 2) as bigint)
  when clock_from = '1:02:03' then 3723 else 1000000000 end"""


def query(spark: SparkSession, sf_dir: str, ctes: str, select: str) -> DataFrame:
    """``select`` over the row tables that ``ctes`` defines from ``pitch``."""
    events = read_source(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    return spark.sql(each(f"with pitch as ({projection_sql('spark')}) {ctes} {select}", "spark"), events=events)


def nested(parent: str, keys: str, child: str, order: str, fields: str, name: str) -> str:
    """Spark SQL of a table ``{name}_in``: ``parent`` with its ``child`` rows (by ``keys``, in ``order``) as an array
    ``name`` of structs of ``fields``; without children it is empty."""
    return f"""
, {name}_list as (select {keys}, transform(sort_array(collect_list(struct({order} as o, struct({fields}) as c))), x -> x.c) as {name} from {child} group by {keys}),
{name}_in as (select {parent}.*, coalesce({name}_list.{name}, array()) as {name} from {parent} left join {name}_list using ({keys}))"""


def match_files(spark: SparkSession, sf_dir: str, ctes: str, parent: str, order: str, fields: str, folder: str) -> DataFrame:
    """``(_file, value)``: one file a match, the list of its ``parent`` rows as objects of ``fields``."""
    docs = ", doc as (select distinct match_id from pitch)" + nested("doc", "match_id", parent, order, fields, "items")
    return query(spark, sf_dir, ctes + docs,
                 f"select concat('/raw/{folder}/', cast(match_id as string), '.json') as _file, to_json(items) as value from items_in")


def lineup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineup documents."""
    ctes = (LINEUP_ROWS
            + nested("member", "match_id, entry_pos, pos", "segment", "seg",
                     "position_id, position_name as position, clock_from as `from`, clock_to as `to`, start_reason", "positions")
            + nested("entry", "match_id, entry_pos", "positions_in", "pos", "player_id, player_name, jersey_number, positions", "lineup"))
    return match_files(spark, sf_dir, ctes, "lineup_in", "entry_pos", "team_id, team_name, lineup", "lineups")


#: Events as the raw files have them. Every 200th is a 'Starting XI' with a formation in one of
#: several spellings; a location without x is missing; shots end in two or three numbers.
EVENT_ROWS = """
, raw_event as (select event_id, match_id, event_index, period, minute, second, team_id, player_id,
      case when event_index % 200 = 0 then 35 else type_id end as type_id, case when event_index % 200 = 0 then 'Starting XI' else type_name end as type_name,
      case when team_id is not null then concat('Team ', cast(team_id as varchar(20))) end as team_name,
      case when player_id % 13 = 0 then '' when player_id is not null then concat('Player ', cast(player_id as varchar(20))) end as player_name,
      location_x, case when location_x is not null then location_y end as location_y,
      pass_end_location_x, case when pass_end_location_x is not null then pass_end_location_y end as pass_end_location_y, pass_outcome_name,
      case when event_index % 200 <> 0 then shot_statsbomb_xg end as shot_statsbomb_xg, shot_outcome_id,
      case shot_outcome_id when 96 then 'Saved' when 97 then 'Goal' when 98 then 'Off T' when 99 then '99' when 100 then ' Blocked ' end as shot_outcome_name,
      case when type_name = 'Shot' then cast(120 as double) end as shot_end_x, case when type_name = 'Shot' then cast(event_index % 80 as double) end as shot_end_y,
      case when type_name = 'Shot' and event_index % 2 = 0 then cast(1.5 as double) end as shot_end_z,
      body_part_id, event_index % 3 = 0 as under_pressure,
      case when event_index % 200 = 0 then case match_id % 5 when 0 then '442' when 1 then '4-2-3-1' when 2 then ' 34111 ' when 3 then '33' else null end end as formation
    from pitch)
"""

#: Matches: names given or blank, scores that agree with the shots in two of three matches.
MATCH_ROWS = """
, goals as (select match_id, team_id, count(*) as goals from pitch where type_name = 'Shot' and shot_outcome_id = 97 and team_id is not null group by match_id, team_id),
raw_match as (select m.match_id, m.match_id % 4 as competition_id, 100 + m.match_id % 3 as season_id, m.home_team_id, m.away_team_id,
      case when m.match_id % 6 <> 0 then concat(' Team ', cast(m.home_team_id as varchar(20)), ' ') end as home_team_name,
      case when m.match_id % 6 = 1 then '' else concat('Team ', cast(m.away_team_id as varchar(20))) end as away_team_name,
      concat('2024-0', cast(1 + m.match_id % 9 as varchar(20)), '-1', cast(m.match_id % 10 as varchar(20))) as match_date,
      case when m.match_id % 3 = 0 then '18:00:00' end as kick_off,
      coalesce(h.goals, 0) + case when m.match_id % 3 = 1 then 1 else 0 end as home_score, coalesce(a.goals, 0) as away_score,
      case when m.match_id % 8 = 0 then 'available' when m.match_id % 8 = 1 then '' end as match_status_360
    from (select distinct match_id, home_team_id, away_team_id from pitch) m
    left join goals h on h.match_id = m.match_id and h.team_id = m.home_team_id
    left join goals a on a.match_id = m.match_id and a.team_id = m.away_team_id)
"""

#: Three-sixty: an entry for every tenth event, its area (null, empty or with a spare number at
#: times) and up to three players, whose place may be missing.
AREA_ROWS = """
, area as (select event_id, match_id, event_index, case when event_index % 40 = 0 then 'event_uuid' else 'id' end as named,
      case event_index % 50 when 0 then null when 10 then 0 else 4 + event_index % 7 end as numbers
    from pitch where event_index % 10 = 0 and match_id % 3 <> 1),
frame as (select match_id, event_id, n, case when (event_index + n) % 4 = 0 then event_index + n end as player_id,
      n = 0 as actor, n < 2 as teammate, case when n = 2 then true end as keeper,
      case when (event_index + n) % 5 <> 0 then cast((event_index * 3 + n * 17) % 125 as double) end as x,
      cast((event_index * 7 + n * 11) % 84 as double) as y
    from (select *, EACH(0, 1, 2) as n from area) k where n <= cast(floor(event_index / 10.0) as int) % 4 - 1)
"""

#: Declared records of the documents above, the shapes that inference finds in real files.
EVENT_RECORD = ("id string, `index` bigint, period bigint, minute bigint, second bigint, type struct<id: bigint, name: string>, team struct<id: bigint, name: string>, "
                "player struct<id: bigint, name: string>, location array<double>, under_pressure boolean, pass struct<end_location: array<double>, outcome: struct<name: string>>, "
                "shot struct<statsbomb_xg: double, end_location: array<double>, outcome: struct<id: bigint, name: string>, body_part: struct<id: bigint>>, "
                "tactics struct<formation: string, lineup: array<struct<player: bigint>>>")
MATCH_RECORD = ("match_id bigint, match_date string, kick_off string, competition struct<competition_id: bigint, country_name: string, competition_name: string>, "
                "season struct<season_id: bigint, season_name: string>, home_team struct<home_team_id: bigint, home_team_name: string>, "
                "away_team struct<away_team_id: bigint, away_team_name: string>, home_score bigint, away_score bigint, match_status_360 string")
THREE_SIXTY_RECORD = ("event_uuid string, id string, visible_area array<double>, freeze_frame array<struct<"
                      "player_id: string, teammate: boolean, actor: boolean, keeper: boolean, location: array<double>>>")


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event documents."""
    fields = """event_id as id, event_index as `index`, period, minute, second, struct(type_id as id, type_name as name) as type,
      case when team_id is not null then struct(team_id as id, team_name as name) end as team, case when player_id is not null then struct(player_id as id, player_name as name) end as player,
      case when location_x is not null then array(location_x, location_y) end as location, under_pressure,
      case when type_id = 30 then struct(case when pass_end_location_x is not null then array(pass_end_location_x, pass_end_location_y) end as end_location, struct(pass_outcome_name as name) as outcome) end as pass,
      case when type_name = 'Shot' then struct(shot_statsbomb_xg as statsbomb_xg, case when shot_end_z is null then array(shot_end_x, shot_end_y) else array(shot_end_x, shot_end_y, shot_end_z) end as end_location,
        struct(shot_outcome_id as id, shot_outcome_name as name) as outcome, struct(body_part_id as id) as body_part) end as shot,
      case when type_id = 35 then struct(formation, array(struct(1 as player), struct(2 as player)) as lineup) end as tactics"""
    return match_files(spark, sf_dir, EVENT_ROWS, "raw_event", "event_index", fields, "events")


def match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match documents: a single object a file."""
    fields = """match_id, match_date, kick_off, struct(competition_id, 'Land' as country_name, concat('Cup ', cast(competition_id as string)) as competition_name) as competition,
      struct(season_id, cast(1900 + season_id as string) as season_name) as season, struct(home_team_id, home_team_name) as home_team,
      struct(away_team_id, away_team_name) as away_team, home_score, away_score, match_status_360"""
    return query(spark, sf_dir, MATCH_ROWS, f"select concat('/raw/matches/', cast(match_id as string), '.json') as _file, to_json(struct({fields})) as value from raw_match")


def three_sixty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-sixty documents."""
    ctes = AREA_ROWS + nested("area", "match_id, event_id", "frame", "n",
                              "cast(player_id as string) as player_id, teammate, actor, keeper, case when x is not null then array(x, y) end as location", "freeze_frame")
    fields = """case when named = 'event_uuid' then event_id end as event_uuid, case when named = 'id' then event_id end as id,
      case when numbers = 0 then array() when numbers is not null then transform(sequence(1, numbers), i -> cast(i as double)) end as visible_area, freeze_frame"""
    return match_files(spark, sf_dir, ctes, "freeze_frame_in", "event_index", fields, "three-sixty")
