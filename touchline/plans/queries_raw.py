"""Driver queries of the raw path: documents made from the pitch projection are parsed, flattened
and turned into tables; the oracles compute the same from the rows behind the documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators import ingest, lineups, model, quality, views
from touchline.plans import catalog
from touchline.plans.catalog import pitch_dims, pitch_events, register, round_doubles
from touchline.sources import raw_projection as raw
from touchline.sources.json_files import LINEUP_RECORD, ingest_order, parse_whole_files


def oracle(body: str) -> str:
    return raw.each(catalog.oracle(body), "duckdb")


def lineup_records(spark, sf):
    return parse_whole_files(raw.lineup_files(spark, sf), T._parse_datatype_string(LINEUP_RECORD), "lineups")[0]


def match_sides(spark, sf):
    """The teams whose eleven is wanted: both sides of each match, with their names."""
    dims = pitch_dims(spark, pitch_events(spark, sf))
    sides = dims["dim_match"].select("match_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    return sides.join(dims["dim_team"], "team_id").select("match_id", "team_id", "team_name")


# The entry by id, name or as the only one; starters, primary position.
_XI_DOC_SQL = raw.LINEUP_ROWS + f"""
, wanted as (select match_id, src as team_id, 'Team ' || cast(src as varchar) as team_name from sides),
sized as (select *, count(*) over (partition by match_id) as entries from entry),
way as (select w.match_id, w.team_id, e.entry_pos,
     case when e.team_id = w.team_id then 0 when lower(trim(e.team_name)) = lower(trim(w.team_name)) then 1 when e.entries = 1 then 2 end as rnk
   from wanted w join sized e on e.match_id = w.match_id),
chosen as (select * from way where rnk is not null qualify row_number() over (partition by match_id, team_id order by rnk, entry_pos) = 1),
seg as (select *, {raw.SEGMENT_SECONDS} as secs, coalesce(lower(trim(start_reason)) = 'starting xi', false) as st,
          coalesce(clock_from = '00:00', false) as ko from segment),
prim as (select * from seg qualify row_number() over (partition by match_id, entry_pos, pos
          order by case when st and ko then 0 when st then 1 else 2 end, case when st and ko then 0 else secs end, seg) = 1),
early as (select match_id, entry_pos, pos, bool_or(st) as any_st, arg_min(ko, (secs, seg)) as ko from seg group by match_id, entry_pos, pos),
mem as (select m.*, coalesce(e.any_st or e.ko, false) as starter, p.position_id, p.position_name from member m
   left join early e on e.match_id = m.match_id and e.entry_pos = m.entry_pos and e.pos = m.pos
   left join prim p on p.match_id = m.match_id and p.entry_pos = m.entry_pos and p.pos = m.pos),
cut as (select *, row_number() over (partition by match_id, entry_pos order by pos) as all_no,
          bool_or(starter) over (partition by match_id, entry_pos) as has_starter from mem),
num as (select *, row_number() over (partition by match_id, entry_pos order by pos) as sort_order from cut
   where case when has_starter then starter else all_no <= 11 end),
uniq as (select * from num qualify row_number() over (partition by match_id, entry_pos, player_id, player_name order by sort_order) = 1),
xi as (select * from uniq qualify row_number() over (partition by match_id, entry_pos order by sort_order) <= 11)
"""


@register("xi_from_lineups", oracle(_XI_DOC_SQL + """
select c.match_id, c.team_id, cast(x.player_id as bigint) as player_id, x.player_name, x.jersey_number, cast(x.position_id as bigint) as position_id,
  x.position_name, cast(x.sort_order as int) as sort_order, c.rnk as way
from chosen c join xi x on x.match_id = c.match_id and x.entry_pos = c.entry_pos"""))
def q_xi_from_lineups(spark, sf):
    xi = lineups.xi_from_lineups(ingest.lineup_entries(lineup_records(spark, sf)), match_sides(spark, sf))
    return xi.select("match_id", "team_id", "player_id", "player_name", "jersey_number", "position_id", "position_name", "sort_order", F.col("entry_way").alias("way"))


# W9 over elevens that are short or hold a name twice.
@register("xi_document_warnings", oracle(_XI_DOC_SQL + """
select c.match_id, c.team_id, count(*) as players, count(distinct x.player_name) as distinct_names, count(*) <> 11 as size_warning,
  count(*) <> count(distinct x.player_name) as duplicate_names
from chosen c join xi x on x.match_id = c.match_id and x.entry_pos = c.entry_pos group by c.match_id, c.team_id"""))
def q_xi_document_warnings(spark, sf):
    return lineups.xi_warnings(lineups.xi_from_lineups(ingest.lineup_entries(lineup_records(spark, sf)), match_sides(spark, sf)))


def records(spark, files, schema, processor):
    return parse_whole_files(files, T._parse_datatype_string(schema), processor)[0]


def raw_events(spark, sf):
    return ingest.events_table(records(spark, raw.event_files(spark, sf), raw.EVENT_RECORD, "events"))


def raw_matches(spark, sf):
    return ingest.matches_table(records(spark, raw.match_documents(spark, sf), raw.MATCH_RECORD, "matches"))


def raw_three_sixty(spark, sf):
    return ingest.three_sixty_tables(records(spark, raw.three_sixty_files(spark, sf), raw.THREE_SIXTY_RECORD, "three-sixty"))


# Nested events to flat rows, match id from the file's name.
@register("raw_events", oracle(raw.EVENT_ROWS + """
select event_id, match_id, event_index, period, minute, second, team_id, team_name, player_id, player_name, type_id, type_name, under_pressure,
  round(location_x, 6) as location_x, round(location_y, 6) as location_y, round(pass_end_location_x, 6) as pass_end_location_x,
  round(pass_end_location_y, 6) as pass_end_location_y, round(case when type_id <> 35 then shot_end_x end, 6) as shot_end_location_x,
  round(case when type_id <> 35 then shot_end_y end, 6) as shot_end_location_y, round(case when type_id <> 35 then shot_end_z end, 6) as shot_end_location_z,
  case when type_id = 30 then pass_outcome_name end as pass_outcome_name, round(case when type_id <> 35 then shot_statsbomb_xg end, 6) as shot_statsbomb_xg,
  case when type_id <> 35 then shot_outcome_id end as shot_outcome_id, formation as tactics_formation,
  case when type_id = 35 then '[{"player":1},{"player":2}]' end as tactics_lineup, case when location_x is not null then 2 end as location_numbers
from (select event_id, match_id, event_index, period, minute, second, team_id, team_name, player_id, player_name, type_id, type_name, under_pressure, location_x, location_y,
        case when type_id = 30 then pass_end_location_x end as pass_end_location_x, case when type_id = 30 then pass_end_location_y end as pass_end_location_y,
        shot_end_x, shot_end_y, shot_end_z, pass_outcome_name, shot_statsbomb_xg, shot_outcome_id, formation from raw_event)"""))
def q_raw_events(spark, sf):
    ev = raw_events(spark, sf)
    return round_doubles(ev.select(
        "event_id", "match_id", "event_index", "period", "minute", "second", "team_id", "team_name", "player_id", "player_name", "type_id", "type_name",
        "under_pressure", "location_x", "location_y", "pass_end_location_x", "pass_end_location_y", "shot_end_location_x", "shot_end_location_y",
        "shot_end_location_z", "pass_outcome_name", "shot_statsbomb_xg", "shot_outcome_id", "tactics_formation", "tactics_lineup",
        F.json_array_length("location").alias("location_numbers")))


# The first formation that can be read.
@register("formations", oracle(raw.EVENT_ROWS + """
, f as (select match_id, team_id, event_index, case when match_id % 5 = 0 then '4-4-2' when match_id % 5 = 1 then '4-2-3-1' when match_id % 5 = 2 then '3-4-1-1-1' end as formation
        from raw_event where type_id = 35)
select match_id, team_id, arg_min(coalesce(formation, 'none'), event_index) as formation from f group by match_id, team_id"""))
def q_formations(spark, sf):
    return lineups.formations(raw_events(spark, sf)).withColumn("formation", F.coalesce("formation", F.lit("none")))


# Labels of the source win unless they look like numbers.
@register("legacy_shot_labels", oracle(raw.EVENT_ROWS + """
select r.event_id, case when r.shot_outcome_id in (96, 97, 98) then r.shot_outcome_name when r.shot_outcome_id = 100 then 'Blocked' else o.shot_outcome_name end as shot_outcome
from raw_event r left join dim_shot_outcome o on o.shot_outcome_id = r.shot_outcome_id where r.type_name = 'Shot'"""))
def q_legacy_labels(spark, sf):
    shots = raw_events(spark, sf).where("type_name = 'Shot'").select("event_id", "shot_outcome_id", "shot_outcome_name")
    dims = pitch_dims(spark, pitch_events(spark, sf))
    return views.ensure_shot_labels(shots, dims["dim_shot_outcome"], None, None).select("event_id", "shot_outcome")


# Nested ids and names of matches.
@register("raw_matches", oracle(raw.MATCH_ROWS + """
select match_id, competition_id, season_id, match_date, kick_off, home_team_id, coalesce(trim(home_team_name), '') as home_team_name, away_team_id,
  coalesce(away_team_name, '') as away_team_name, home_score, away_score from raw_match"""))
def q_raw_matches(spark, sf):
    return raw_matches(spark, sf).select("match_id", "competition_id", "season_id", "match_date", "kick_off", "home_team_id", "home_team_name", "away_team_id",
                                         "away_team_name", "home_score", "away_score")


# The match dimension with its label and the availability of three-sixty data.
@register("dim_match_from_raw", oracle(raw.MATCH_ROWS + raw.AREA_ROWS + """
, n as (select *, coalesce(trim(home_team_name), '') as h, coalesce(trim(away_team_name), '') as a from raw_match)
select match_id, competition_id, season_id, h as home_team_name, a as away_team_name, case when h <> '' or a <> '' then h || ' vs ' || a || ' (' || match_date || ')' else '' end as match_label,
  coalesce(kick_off, '') as kick_off, case when coalesce(match_status_360, '') <> '' or match_id in (select match_id from area where numbers is not null) then 1 else 0 end as is_360_available
from n"""))
def q_dim_match_from_raw(spark, sf):
    main, _, areas = raw_three_sixty(spark, sf)
    dm = model.dim_match(raw_matches(spark, sf).withColumn("_ord", ingest_order()), "_ord", model.three_sixty_match_ids(areas, main))
    return dm.select("match_id", "competition_id", "season_id", "home_team_name", "away_team_name", "match_label", "kick_off", "is_360_available")


# Competitions, plain and nested.
@register("raw_competitions", oracle("""
select distinct match_id % 4 as competition_id, 'Cup ' || cast(match_id % 4 as varchar) as competition_name, 'Land' as country_name, 100 + match_id % 3 as season_id,
  cast(2000 + match_id % 3 as varchar) as season_name from pitch"""))
def q_raw_competitions(spark, sf):
    found = records(spark, raw.match_documents(spark, sf), raw.MATCH_RECORD, "competitions")
    comps = ingest.competitions_table(found.select("competition", "season", *ingest.ORDER_COLS))
    return comps.select("competition_id", "competition_name", "country_name", "season_id", "season_name").distinct()


# Lineup rows, and the fact made of them.
@register("raw_lineups", oracle(raw.LINEUP_ROWS + """
select m.match_id, e.team_id, coalesce(e.team_name, '') as team_name, m.player_id, coalesce(m.player_name, '') as player_name, m.jersey_number, s.position_id, s.position_name,
  s.clock_from as "from", s.clock_to as "to", coalesce(s.start_reason = 'Starting XI', false) as starter
from member m join entry e on e.match_id = m.match_id and e.entry_pos = m.entry_pos
left join segment s on s.match_id = m.match_id and s.entry_pos = m.entry_pos and s.pos = m.pos and s.seg = 0"""))
def q_raw_lineups(spark, sf):
    return ingest.lineups_table(lineup_records(spark, sf)).drop(*ingest.ORDER_COLS)


@register("fact_lineups_players", oracle(raw.LINEUP_ROWS + """
select m.match_id, e.team_id, m.player_id, cast(s.position_id as bigint) as position_id, case when m.player_id % 4 <> 1 then m.jersey_number end as jersey_number,
  coalesce(s.start_reason = 'Starting XI', false) as starter, s.clock_from as "from", s.clock_to as "to"
from member m join entry e on e.match_id = m.match_id and e.entry_pos = m.entry_pos
left join segment s on s.match_id = m.match_id and s.entry_pos = m.entry_pos and s.pos = m.pos and s.seg = 0"""))
def q_fact_lineups(spark, sf):
    rows = ingest.lineups_table(lineup_records(spark, sf))
    nested = F.when(F.col("player_id") % 4 == 1, F.concat(F.lit(" ["), F.col("jersey_number"), F.lit("]"))).otherwise(F.col("jersey_number"))
    return model.fact_lineups_players(rows.withColumn("jersey_number", nested))


# Three-sixty rows, areas and frames, and the facts made of them.
@register("raw_three_sixty", oracle(raw.AREA_ROWS + """
select match_id, event_id as event_uuid from area"""))
def q_raw_three_sixty(spark, sf):
    return raw_three_sixty(spark, sf)[0].select("match_id", "event_uuid")


@register("raw_visible_areas", oracle(raw.AREA_ROWS + """
select match_id, event_id as event_uuid, cast(floor(numbers / 2.0) as bigint) as visible_area_point_count, numbers, case when numbers > 0 then cast(numbers as double) end as last
from area where numbers is not null"""))
def q_raw_visible_areas(spark, sf):
    areas = raw_three_sixty(spark, sf)[2].withColumn("a", F.from_json("visible_area", "array<double>"))
    return areas.select("match_id", "event_uuid", "visible_area_point_count", F.size("a").alias("numbers"), F.try_element_at("a", F.lit(-1)).alias("last"))


@register("fact_three_sixty", oracle(raw.AREA_ROWS + """
select match_id, event_id as event_uuid, cast(floor(numbers / 2.0) as bigint) as visible_area_point_count, case when numbers > 1 then 1 else 0 end as has_visible_area
from area where numbers is not null"""))
def q_fact_three_sixty(spark, sf):
    main, _, areas = raw_three_sixty(spark, sf)
    return model.fact_three_sixty(areas, main)


@register("fact_freeze_frames", oracle(raw.AREA_ROWS + """
select match_id, event_id as event_uuid, player_id, teammate, actor, keeper, x as location_x, case when x is not null then y end as location_y,
  case when x between 0 and 120 and y between 0 and 80 then cast(least(4, floor(y / 16)) * 6 + least(5, floor(x / 20)) as bigint) end as zone_id from frame"""))
def q_fact_freeze_frames(spark, sf):
    return round_doubles(model.fact_three_sixty_freeze_frames(raw_three_sixty(spark, sf)[1]))


# Teams and players, the last source that names them wins.
@register("raw_teams", oracle(raw.MATCH_ROWS + raw.LINEUP_ROWS + """
, ev as (select distinct team_id, 'Team ' || cast(team_id as varchar) as name from pitch where team_id is not null),
sides2 as (select home_team_id as team_id, coalesce(trim(home_team_name), '') as name, match_id, 0 as side from raw_match
           union all select away_team_id, coalesce(away_team_name, ''), match_id, 1 from raw_match),
m as (select team_id, arg_max(name, ('/raw/matches/' || cast(match_id as varchar) || '.json', side)) as name from sides2 group by team_id),
l as (select team_id, arg_max(coalesce(team_name, ''), ('/raw/lineups/' || cast(match_id as varchar) || '.json', entry_pos)) as name from entry where team_id is not null group by team_id),
ids as (select team_id from ev union select team_id from m union select team_id from l)
select i.team_id, coalesce(l.name, m.name, ev.name) as team_name from ids i left join l on l.team_id = i.team_id left join m on m.team_id = i.team_id
left join ev on ev.team_id = i.team_id"""))
def q_raw_teams(spark, sf):
    found = lineup_records(spark, sf)
    return ingest.etl_dimensions(raw_events(spark, sf), raw_matches(spark, sf), ingest.lineups_table(found), None, entries=ingest.lineup_entries(found))[0]


@register("raw_players", oracle(raw.EVENT_ROWS + raw.LINEUP_ROWS + raw.AREA_ROWS + """
, e as (select player_id, arg_max({'n': player_name, 't': team_id}, ('/raw/events/' || cast(match_id as varchar) || '.json', event_index)) as r
        from raw_event where player_id is not null group by player_id),
l as (select m.player_id, arg_max({'n': coalesce(m.player_name, ''), 't': e.team_id}, ('/raw/lineups/' || cast(m.match_id as varchar) || '.json', m.entry_pos, m.pos)) as r
      from member m join entry e on e.match_id = m.match_id and e.entry_pos = m.entry_pos group by m.player_id),
known as (select player_id from e union select player_id from l)
select k.player_id, case when l.player_id is not null then l.r.n else e.r.n end as player_name, case when l.player_id is not null then l.r.t else e.r.t end as team_id
from known k left join l on l.player_id = k.player_id left join e on e.player_id = k.player_id
union all select distinct player_id, '', cast(null as bigint) from frame where player_id is not null and player_id not in (select player_id from known)"""))
def q_raw_players(spark, sf):
    found = lineup_records(spark, sf)
    return ingest.etl_dimensions(raw_events(spark, sf), None, ingest.lineups_table(found), raw_three_sixty(spark, sf)[1])[1]


# K4, Q4: broken files are set aside whole; what was found, done and failed.
@register("broken_files", oracle("""
, f as (select match_id, case when match_id % 2 = 0 then 'matches' else 'lineups' end as processor from (select distinct match_id from pitch) m)
select processor, count(*) as found, count(*) filter (where match_id % 4 < 3) as processed, count(*) filter (where match_id % 4 < 3 and match_id % 3 = 2) as failed,
  count(*) filter (where match_id % 4 = 3) as skipped_unchanged from f group by processor"""))
def q_broken_files(spark, sf):
    whole = raw.match_documents(spark, sf)
    match = F.regexp_extract("_file", r"(\d+)\.json", 1).cast("bigint")
    processor = F.when(match % 2 == 0, "matches").otherwise("lineups")
    broken = whole.select("_file", F.when(match % 3 == 2, F.expr("substr(value, 1, length(value) - 5)")).otherwise(F.col("value")).alias("value"))
    listing = whole.select(processor.alias("processor"), F.col("_file").alias("path"), match.alias("m"))
    _, quarantine = parse_whole_files(broken.where(match % 4 < 3), T._parse_datatype_string(raw.MATCH_RECORD), "matches")
    failed = quarantine.select(F.col("path").alias("_file"), "reason").select(processor.alias("processor"), F.col("_file").alias("path"), "reason")
    return quality.file_summary(listing, listing.where("m % 4 < 3"), failed).select("processor", "found", "processed", "failed", "skipped_unchanged")


# Q2, Q7: columns that must, and must not, be there.
@register("contract_checks", """
select * from (values ('events', 'event_id', true), ('events', 'match_id', true), ('events', 'team_id', true), ('events', 'player_id', true), ('events', 'type_id', true),
  ('events', 'type_name', true), ('events', 'minute', true), ('events', 'second', true), ('three_sixty', 'match_id', true), ('three_sixty', 'event_uuid', false),
  ('fact_shots', 'has shot_outcome_id', true), ('fact_shots', 'has body_part_id', true), ('fact_shots', 'has shot_type_id', true), ('fact_shots', 'no shot_outcome', true),
  ('fact_shots', 'no shot_outcome_name', true), ('fact_shots', 'no shot_type', true), ('fact_shots', 'no shot_type_name', true), ('fact_shots', 'no body_part', true),
  ('fact_shots', 'no body_part_name', true), ('raw shots', 'has shot_outcome_id', true), ('raw shots', 'has body_part_id', false), ('raw shots', 'has shot_type_id', false),
  ('raw shots', 'no shot_outcome', true), ('raw shots', 'no shot_outcome_name', false), ('raw shots', 'no shot_type', true), ('raw shots', 'no shot_type_name', true),
  ('raw shots', 'no body_part', true), ('raw shots', 'no body_part_name', true)) t("table", "check", ok)""")
def q_contract_checks(spark, sf):
    ev = raw_events(spark, sf)
    tables = {"events": ev, "three_sixty": raw_three_sixty(spark, sf)[0].drop("event_uuid")}
    required = quality.required_columns_check(spark, tables, ingest.REQUIRED_COLUMNS).toDF("table", "check", "ok")
    for name, df in (("fact_shots", model.fact_shots(ev, ingest_order())), ("raw shots", ev)):
        required = required.unionByName(quality.fact_shots_contract(spark, df).select(F.lit(name).alias("table"), "check", F.col("passed").alias("ok")))
    return required


# A26 with D1 over parsed files: the facts as the export makes them.
@register("fact_shots_from_raw", oracle(raw.EVENT_ROWS + """
select event_id, match_id, team_id, player_id, minute, second, period, shot_outcome_id, body_part_id, round(location_x, 6) as location_x, round(shot_end_y, 6) as shot_end_location_y,
  round(shot_statsbomb_xg, 6) as shot_statsbomb_xg, period * 100000 + minute * 100 + second as time_key
from raw_event where type_name = 'Shot'"""))
def q_fact_shots_from_raw(spark, sf):
    fs = model.fact_shots(raw_events(spark, sf), ingest_order())
    return round_doubles(fs.select("event_id", "match_id", "team_id", "player_id", "minute", "second", "period", "shot_outcome_id", "body_part_id", "location_x",
                                   "shot_end_location_y", "shot_statsbomb_xg", "time_key"))
