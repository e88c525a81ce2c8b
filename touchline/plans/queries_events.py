"""Driver queries for event-level operators (tactical filters, possessions,
coordinate maths) over the pitch projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import normalize, tactical
from touchline.functions import pitch as P
from touchline.plans.catalog import oracle, pitch_dims, pitch_events, register, round_doubles

BASE = ("match_id, event_id, team_id, player_id, type_name, minute, second, "
        "round(location_x, 6) as location_x, round(location_y, 6) as location_y, "
        "round(pass_end_location_x, 6) as pass_end_location_x, round(pass_end_location_y, 6) as pass_end_location_y")
COMPLETE = "(pass_outcome_name is null or pass_outcome_name = '')"

_POSSESSION_SQL = """,
o as (select *, (coalesce(period, 1) - 1) * 2700 + coalesce(minute, 0) * 60 + coalesce(second, 0) as abs_s,
        row_number() over (partition by match_id order by period nulls last, minute nulls last,
                           second nulls last, event_index nulls last, event_id) as rn
      from pitch),
f as (select *, case when coalesce(period = lag(period) over w, false)
                      and coalesce(team_id = lag(team_id) over w, false)
                      and not coalesce(abs_s - lag(abs_s) over w > {gap}, false) then 0 else 1 end as is_new
      from o window w as (partition by match_id order by rn)),
lab as (select *, cast(sum(is_new) over (partition by match_id order by rn rows between unbounded preceding
                                        and current row) as bigint) as possession_id from f)
"""


def possession_sql(gap: int = 10) -> str:
    return _POSSESSION_SQL.replace("{gap}", str(gap))


SUMMARY_SQL = """,
summ as (select match_id, possession_id,
   arg_min(team_id, rn) filter (where team_id is not null) as team_id,
   arg_min(period, rn) filter (where period is not null) as start_period,
   arg_min(minute, rn) filter (where minute is not null) as start_minute,
   arg_min(second, rn) filter (where second is not null) as start_second,
   arg_max(period, rn) filter (where period is not null) as end_period,
   arg_max(minute, rn) filter (where minute is not null) as end_minute,
   arg_max(second, rn) filter (where second is not null) as end_second,
   count(event_id) as event_count,
   arg_min(location_x, rn) filter (where location_x is not null) as start_x,
   arg_min(location_y, rn) filter (where location_y is not null) as start_y,
   arg_max(location_x, rn) filter (where location_x is not null) as end_x,
   arg_max(location_y, rn) filter (where location_y is not null) as end_y
 from lab group by match_id, possession_id),
summary as (select *, case when (end_minute * 60 + end_second) - (start_minute * 60 + start_second) is null then null
     else greatest((end_minute * 60 + end_second) - (start_minute * 60 + start_second), 0) end as duration_seconds
   from summ)
"""


@register("final_third_passes", oracle(f"""
select {BASE}, 'pass_into_final_third' as metric from pitch
where type_name = 'Pass' and {COMPLETE} and location_x < 80 and pass_end_location_x >= 80"""))
def q_final_third(spark, sf):
    return round_doubles(tactical.passes_into_final_third(pitch_events(spark, sf)))


@register("progressive_passes", oracle(f"""
select {BASE}, round(pass_end_location_x - location_x, 6) as progressive_distance, 'progressive_pass' as metric
from pitch where type_name = 'Pass' and {COMPLETE} and pass_end_location_x - location_x > 0 and (
  (location_x < 60 and pass_end_location_x < 60 and pass_end_location_x - location_x >= 15) or
  (location_x < 60 and pass_end_location_x >= 60 and pass_end_location_x - location_x >= 10) or
  (location_x >= 60 and pass_end_location_x >= 60 and pass_end_location_x - location_x >= 10))"""))
def q_progressive(spark, sf):
    return round_doubles(tactical.progressive_passes(pitch_events(spark, sf)))


@register("box_entries", oracle(f"""
select {BASE}, type_name as entry_type, 'box_entry' as metric from pitch
where (type_name = 'Pass' and {COMPLETE} and location_x < 102 and pass_end_location_x >= 102
       and pass_end_location_y between 18 and 62)
   or (type_name = 'Carry' and location_x < 102 and carry_end_location_x >= 102
       and carry_end_location_y between 18 and 62)"""))
def q_box_entries(spark, sf):
    return round_doubles(tactical.box_entries(pitch_events(spark, sf)))


@register("defensive_actions_opp_half", oracle(f"""
select {BASE}, 'defensive_action_opposition_half' as metric from pitch
where type_name in ('Pressure', 'Duel', 'Interception', 'Block', 'Ball Recovery', 'Clearance', 'Foul Committed')
  and location_x >= 60"""))
def q_def_actions(spark, sf):
    return round_doubles(tactical.defensive_actions_in_opposition_half(pitch_events(spark, sf)))


@register("possession_labels", oracle(possession_sql() + """
select match_id, event_id, possession_id from lab"""))
def q_possession_labels(spark, sf):
    return tactical.possessions(pitch_events(spark, sf)).select("match_id", "event_id", "possession_id")


@register("possessions", oracle(possession_sql() + SUMMARY_SQL + """
select match_id, possession_id, team_id, start_period, start_minute, start_second, end_period, end_minute,
  end_second, event_count, round(start_x, 6) as start_x, round(start_y, 6) as start_y, round(end_x, 6) as end_x,
  round(end_y, 6) as end_y, duration_seconds from summary"""))
def q_possessions(spark, sf):
    ev = pitch_events(spark, sf)
    return round_doubles(tactical.possession_summary(tactical.possessions(ev)))


@register("basic_summary", oracle("""
select match_id, metric, value from (
  select match_id, count(*) as total_events, count(*) filter (where type_name = 'Pass') as passes,
         count(*) filter (where type_name = 'Shot') as shots,
         count(*) filter (where type_name = 'Pressure') as pressures,
         count(*) filter (where type_name = 'Duel') as duels
  from pitch group by match_id)
unpivot (value for metric in (total_events, passes, shots, pressures, duels))"""))
def q_basic_summary(spark, sf):
    return tactical.basic_summary(pitch_events(spark, sf))


@register("semantic_measures", oracle("""
select match_id, team_id, count(*) as events, count(*) filter (where type_name = 'Pass') as passes,
  count(*) filter (where type_name = 'Shot') as shots, round(sum(shot_statsbomb_xg), 6) as total_xg,
  count(*) filter (where type_name in ('Pressure', 'Duel', 'Interception', 'Block', 'Ball Recovery', 'Clearance',
                                       'Foul Committed') and location_x >= 60) as defensive_actions_opp_half,
  round(case when count(*) filter (where type_name = 'Pass') = 0 then null else
    cast(count(*) filter (where type_name = 'Pass' and (pass_outcome_name is null or pass_outcome_name = ''))
         as double) / count(*) filter (where type_name = 'Pass') end, 6) as pass_completion_pct
from pitch group by match_id, team_id"""))
def q_measures(spark, sf):
    return round_doubles(tactical.semantic_measures(pitch_events(spark, sf), ["match_id", "team_id"]))


@register("team_profile", oracle(possession_sql() + SUMMARY_SQL + f"""
, teams as (select match_id, team_id, count(*) as events from pitch where team_id is not null
            group by match_id, team_id),
focus as (select *, row_number() over (partition by match_id order by events desc, team_id) = 1 as is_focus_team
          from teams),
prog as (select match_id, team_id, count(*) as n from pitch where type_name = 'Pass' and {COMPLETE}
   and pass_end_location_x - location_x > 0 and (
  (location_x < 60 and pass_end_location_x < 60 and pass_end_location_x - location_x >= 15) or
  (location_x < 60 and pass_end_location_x >= 60 and pass_end_location_x - location_x >= 10) or
  (location_x >= 60 and pass_end_location_x >= 60 and pass_end_location_x - location_x >= 10))
  group by match_id, team_id),
f3 as (select match_id, team_id, count(*) as n from pitch where type_name = 'Pass' and {COMPLETE}
   and location_x < 80 and pass_end_location_x >= 80 group by match_id, team_id),
box as (select match_id, team_id, count(*) as n from pitch
  where (type_name = 'Pass' and {COMPLETE} and location_x < 102 and pass_end_location_x >= 102
         and pass_end_location_y between 18 and 62)
     or (type_name = 'Carry' and location_x < 102 and carry_end_location_x >= 102
         and carry_end_location_y between 18 and 62) group by match_id, team_id),
def as (select match_id, team_id, count(*) as n from pitch
  where type_name in ('Pressure', 'Duel', 'Interception', 'Block', 'Ball Recovery', 'Clearance', 'Foul Committed')
  and location_x >= 60 group by match_id, team_id),
pos as (select match_id, team_id, avg(event_count) as a, avg(duration_seconds) as d, count(*) as n
        from summary group by match_id, team_id)
select t.match_id, t.team_id, t.events, t.is_focus_team,
  coalesce(prog.n, 0) as progressive_passes, coalesce(f3.n, 0) as final_third_passes,
  coalesce(box.n, 0) as box_entries, coalesce(def.n, 0) as defensive_actions_opp_half,
  round(coalesce(pos.a, 0.0), 6) as avg_possession_events, round(coalesce(pos.d, 0.0), 6) as avg_possession_seconds,
  coalesce(pos.n, 0) as possessions
from focus t
left join prog on prog.match_id = t.match_id and prog.team_id = t.team_id
left join f3 on f3.match_id = t.match_id and f3.team_id = t.team_id
left join box on box.match_id = t.match_id and box.team_id = t.team_id
left join def on def.match_id = t.match_id and def.team_id = t.team_id
left join pos on pos.match_id = t.match_id and pos.team_id = t.team_id"""))
def q_team_profile(spark, sf):
    return round_doubles(tactical.team_profile(pitch_events(spark, sf)))


@register("normalized_coordinates", oracle("""
, j as (select p.*, case when p.team_id is not null and p.team_id <> m.home_team_id then true else false end as flip
        from pitch p left join dim_match m on p.match_id = m.match_id),
n as (select *,
  case when location_x is null then null else greatest(0.0, least(100.0, location_x / 120.0 * 100.0)) end as nx,
  case when pass_end_location_x is null then null else greatest(0.0, least(100.0, pass_end_location_x / 120.0 * 100.0)) end as npx,
  case when carry_end_location_x is null then null else greatest(0.0, least(100.0, carry_end_location_x / 120.0 * 100.0)) end as ncx
  from j)
select match_id, event_id, team_id,
  round(case when flip then 100.0 - nx else nx end, 6) as location_x,
  round(case when location_y is not null then greatest(0.0, least(100.0, location_y / 80.0 * 100.0)) end, 6) as location_y,
  round(case when flip then 100.0 - npx else npx end, 6) as pass_end_location_x,
  round(case when pass_end_location_y is not null then greatest(0.0, least(100.0, pass_end_location_y / 80.0 * 100.0)) end, 6) as pass_end_location_y,
  round(case when flip then 100.0 - ncx else ncx end, 6) as carry_end_location_x,
  round(case when carry_end_location_y is not null then greatest(0.0, least(100.0, carry_end_location_y / 80.0 * 100.0)) end, 6) as carry_end_location_y
from n"""))
def q_normalize(spark, sf):
    ev = pitch_events(spark, sf)
    dims = pitch_dims(spark, ev)
    out = normalize.normalize_event_coordinates(ev, dims["dim_match"])
    cols = ["match_id", "event_id", "team_id", "location_x", "location_y", "pass_end_location_x",
            "pass_end_location_y", "carry_end_location_x", "carry_end_location_y"]
    return round_doubles(out.select(*cols))


@register("coordinate_bounds", oracle("""
, u as (select match_id, event_id, column_name, value from pitch
  unpivot (value for column_name in (location_x, location_y, pass_end_location_x, pass_end_location_y,
                                     carry_end_location_x, carry_end_location_y)))
select match_id, event_id, column_name, round(value, 6) as value from u where value < 0 or value > 100"""))
def q_bounds(spark, sf):
    ev = pitch_events(spark, sf)
    return round_doubles(normalize.coordinate_bound_issues(ev).select("match_id", "event_id", "column_name", "value"))


@register("zone_time_keys", oracle("""
select match_id, event_id,
  case when location_x between 0 and 120 and location_y between 0 and 80
       then cast(least(5, floor(location_x / 20)) + 6 * least(4, floor(location_y / 16)) as bigint) end as zone_id,
  cast(period as bigint) * 100000 + cast(minute as bigint) * 100 + cast(second as bigint) as time_key,
  cast(greatest((period - 1) * 45 + minute, 0) as bigint) as minute_absolute,
  cast(floor(greatest((period - 1) * 45 + minute, 0) / 5) * 5 as bigint) as time_bucket_5min,
  cast(floor(greatest((period - 1) * 45 + minute, 0) / 15) * 15 as bigint) as time_bucket_15min
from pitch"""))
def q_zone_time(spark, sf):
    ev = pitch_events(spark, sf)
    ma = P.minute_absolute(F.col("period"), F.col("minute"))
    return ev.select("match_id", "event_id",
                     P.zone_id(F.col("location_x"), F.col("location_y")).alias("zone_id"),
                     P.time_key(F.col("period"), F.col("minute"), F.col("second")).alias("time_key"),
                     ma.alias("minute_absolute"),
                     P.bucket(ma, 5).alias("time_bucket_5min"),
                     P.bucket(ma, 15).alias("time_bucket_15min"))
