"""Driver queries for model views and match/team/player reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import model, normalize, reports, tactical, views
from touchline.plans.catalog import oracle, pitch_dims, pitch_events, register, round_doubles
from touchline.sources.fixtures import read_source

_SHOTS_SQL = """,
fs as (select event_id, match_id, team_id, player_id, minute, second, period, location_x, location_y,
              shot_statsbomb_xg, cast(shot_outcome_id as bigint) as shot_outcome_id,
              cast(shot_type_id as bigint) as shot_type_id, cast(body_part_id as bigint) as body_part_id
       from pitch where lower(trim(type_name)) = 'shot' or type_id = 16),
sv as (select fs.*, fs.location_x as x, fs.location_y as y, fs.shot_statsbomb_xg as xg,
         o.shot_outcome_name as shot_outcome, t.shot_type_name as shot_type, b.body_part_name as body_part,
         (coalesce(lower(trim(o.shot_outcome_name)) = 'goal', false) or coalesce(fs.shot_outcome_id = 97, false))
           as is_goal,
         tm.team_name, pl.player_name
       from fs left join dim_shot_outcome o on fs.shot_outcome_id = o.shot_outcome_id
               left join dim_shot_type t on fs.shot_type_id = t.shot_type_id
               left join dim_body_part b on fs.body_part_id = b.body_part_id
               left join dim_team tm on fs.team_id = tm.team_id
               left join dim_player pl on fs.player_id = pl.player_id)
"""


def shots_view(spark, sf):
    """fact_shots -> D2 dedupe -> J3 labels -> J5 view, over the projection."""
    ev = pitch_events(spark, sf)
    dims = pitch_dims(spark, ev)
    fs = model.fact_shots(ev, F.struct("match_id", "event_index"))
    fs = views.dedupe_shots(fs)
    # fixture dims are unique by construction (distinct ids / fixed lists)
    fs = views.ensure_shot_labels(fs, dims["dim_shot_outcome"], dims["dim_body_part"], dims["dim_shot_type"],
                                  dims_unique=True)
    return views.shots_view(fs, dims["dim_team"], dims["dim_player"], dims_unique=True), ev, dims


@register("shots_view", oracle(_SHOTS_SQL + """
select event_id, match_id, team_id, player_id, round(x, 6) as x, round(y, 6) as y, round(xg, 6) as xg,
  shot_outcome, shot_type, body_part, is_goal, team_name, player_name from sv"""))
def q_shots_view(spark, sf):
    sv, _, _ = shots_view(spark, sf)
    return round_doubles(sv.select("event_id", "match_id", "team_id", "player_id", "x", "y", "xg", "shot_outcome",
                                   "shot_type", "body_part", "is_goal", "team_name", "player_name"))


@register("match_stats", oracle(_SHOTS_SQL + """
, per as (select match_id, team_id, count(*) as shots,
     count(*) filter (where lower(trim(shot_outcome)) = 'goal') as goals,
     count(*) filter (where lower(trim(shot_outcome)) in ('goal', 'saved', 'saved to post')) as on_target,
     count(*) filter (where lower(trim(shot_outcome)) in ('off t', 'wayward', 'post')) as off_target,
     count(*) filter (where lower(trim(shot_outcome)) = 'blocked') as blocked,
     sum(coalesce(xg, 0.0)) as xg
   from sv where team_id is not null group by match_id, team_id),
pm as (select match_id, max(case when shot_outcome is not null then 1 else 0 end) as has_out, count(*) as n
       from sv where team_id is not null group by match_id)
select m.match_id, m.home_team_id, m.away_team_id, cast(null as bigint) as home_score,
  cast(null as bigint) as away_score,
  coalesce(h.shots, 0) as shots_home, coalesce(a.shots, 0) as shots_away,
  case when pm.has_out = 1 then coalesce(h.goals, 0) end as goals_home,
  case when pm.has_out = 1 then coalesce(a.goals, 0) end as goals_away,
  case when pm.has_out = 1 then coalesce(h.on_target, 0) end as on_target_home,
  case when pm.has_out = 1 then coalesce(a.on_target, 0) end as on_target_away,
  case when pm.has_out = 1 then coalesce(h.off_target, 0) end as off_target_home,
  case when pm.has_out = 1 then coalesce(a.off_target, 0) end as off_target_away,
  case when pm.has_out = 1 then coalesce(h.blocked, 0) end as blocked_home,
  case when pm.has_out = 1 then coalesce(a.blocked, 0) end as blocked_away,
  case when pm.n > 0 then round(coalesce(h.xg, 0.0), 2) end as xg_home,
  case when pm.n > 0 then round(coalesce(a.xg, 0.0), 2) end as xg_away
from dim_match m left join pm on pm.match_id = m.match_id
left join per h on h.match_id = m.match_id and h.team_id = m.home_team_id
left join per a on a.match_id = m.match_id and a.team_id = m.away_team_id"""))
def q_match_stats(spark, sf):
    sv, ev, dims = shots_view(spark, sf)
    return round_doubles(reports.match_stats(ev, sv, dims["dim_match"]))


@register("shot_kpis", oracle(_SHOTS_SQL + """
select match_id, team_id, count(*) as shots, round(sum(coalesce(xg, 0.0)), 6) as total_xg,
  count(*) filter (where is_goal) as goals, count(distinct player_id) as players
from sv group by match_id, team_id"""))
def q_shot_kpis(spark, sf):
    sv, _, _ = shots_view(spark, sf)
    return round_doubles(reports.shot_kpis(sv, ["match_id", "team_id"]))


@register("player_shot_kpis", oracle(_SHOTS_SQL + """
select player_id, count(*) as shots, round(sum(coalesce(xg, 0.0)), 6) as total_xg,
  count(*) filter (where is_goal) as goals, count(distinct player_id) as players
from sv group by player_id"""))
def q_player_kpis(spark, sf):
    sv, _, _ = shots_view(spark, sf)
    return round_doubles(reports.shot_kpis(sv, ["player_id"]))


@register("shot_outcomes", oracle(_SHOTS_SQL + """
select match_id, team_id, coalesce(shot_outcome, 'Unknown') as shot_outcome, count(*) as count
from sv group by match_id, team_id, coalesce(shot_outcome, 'Unknown')"""))
def q_shot_outcomes(spark, sf):
    sv, _, _ = shots_view(spark, sf)
    return reports.shot_outcome_distribution(sv, ["match_id", "team_id"])


@register("shot_timing", oracle(_SHOTS_SQL + """
select match_id, player_id, minute, count(*) as shots from sv where minute is not null
group by match_id, player_id, minute"""))
def q_shot_timing(spark, sf):
    sv, _, _ = shots_view(spark, sf)
    return reports.shot_timing(sv, ["match_id", "player_id"])


@register("xg_timeline", oracle(_SHOTS_SQL + """
, pm as (select match_id, team_id, minute, coalesce(sum(xg), 0.0) as xg from sv where minute is not null
        group by match_id, team_id, minute)
select match_id, team_id, minute, round(xg, 6) as xg,
  round(sum(xg) over (partition by match_id, team_id order by minute nulls last
                      rows between unbounded preceding and current row), 6) as cum_xg
from pm"""))
def q_xg_timeline(spark, sf):
    sv, _, _ = shots_view(spark, sf)
    return round_doubles(reports.cumulative_xg(sv, ["match_id", "team_id"]))


@register("top_shooters", oracle(_SHOTS_SQL + """
, per as (select match_id, team_id, player_name, count(*) as shots, coalesce(sum(xg), 0.0) as total_xg from sv
          where player_name is not null group by match_id, team_id, player_name)
select match_id, team_id, player_name, shots, round(total_xg, 6) as total_xg, rank from (
  select *, row_number() over (partition by match_id, team_id
                               order by shots desc, total_xg desc nulls last, player_name) as rank from per)
where rank <= 10"""))
def q_top_shooters(spark, sf):
    sv, _, _ = shots_view(spark, sf)
    return round_doubles(reports.top_shooters(sv, ["match_id", "team_id"], 10)).withColumn(
        "rank", F.col("rank").cast("bigint"))


@register("shot_filters", oracle(_SHOTS_SQL + """
select event_id, match_id, round(xg, 6) as xg, shot_type from sv
where coalesce(xg, 0) >= 0.3 and lower(coalesce(shot_type, 'none')) not in ('penalty', 'free kick')"""))
def q_shot_filters(spark, sf):
    sv, _, _ = shots_view(spark, sf)
    f = reports.shot_filters(sv, big_chances=True, open_play_only=True)
    return round_doubles(f.select("event_id", "match_id", "xg", "shot_type"))


@register("goal_shots", oracle(_SHOTS_SQL + """
select event_id, match_id, team_id, shot_outcome from sv where is_goal"""))
def q_goal_shots(spark, sf):
    sv, _, _ = shots_view(spark, sf)
    return reports.shot_filters(sv, only_goals=True).select("event_id", "match_id", "team_id", "shot_outcome")


@register("shot_map_frame", oracle(_SHOTS_SQL + """
, o as (select s.*, m.away_team_id from sv s left join dim_match m on s.match_id = m.match_id)
select event_id, match_id, team_id,
  round(case when coalesce(team_id = away_team_id, false) then 120 - x else x end, 6) as x,
  round(case when coalesce(team_id = away_team_id, false) then 80 - y else y end, 6) as y,
  round(coalesce(xg, 0.0), 6) as xg_plot, coalesce(shot_outcome, 'Unknown') as outcome_text,
  round(7 + 26 * coalesce(xg, 0.0), 6) as marker_size,
  round(80 + 1400 * greatest(coalesce(xg, 0.0), 0.0), 6) as marker_area, coalesce(cast(minute as varchar), '-') as minute_text, coalesce(player_name, '-') as player_text,
  coalesce(shot_type, '-') as shot_type_text, coalesce(body_part, '-') as body_part_text, cast(round_even(coalesce(xg, 0.0) * 100, 0) / 100 as varchar) as xg_text
from o where x is not null and y is not null"""))
def q_shot_map(spark, sf):
    sv, _, dims = shots_view(spark, sf)
    oriented = normalize.orient_shots_to_home(sv, dims["dim_match"])
    fr = reports.shot_map_frame(oriented)
    return round_doubles(fr.select("event_id", "match_id", "team_id", "x", "y", "xg_plot", "outcome_text",
                                   "marker_size", "marker_area", "minute_text", "player_text", "shot_type_text", "body_part_text", "xg_text"))


@register("team_heatmap", oracle("""
select match_id, team_id, cast(least(floor(location_x / 120 * 12), 11) as int) as bin_x,
  cast(least(floor(location_y / 80 * 8), 7) as int) as bin_y, count(*) as touches
from pitch where location_x between 0 and 120 and location_y between 0 and 80
group by all"""))
def q_heatmap(spark, sf):
    return reports.team_heatmap(pitch_events(spark, sf))


_PASSES = """,
np as (select match_id, team_id, player_id as passer, pass_recipient_id as receiver, location_x as x, location_y as y
       from pitch where type_name = 'Pass' and player_id is not null and pass_recipient_id is not null
       and location_x is not null and location_y is not null)
"""


@register("pass_network_nodes", oracle(_PASSES + """
, n as (select match_id, team_id, passer as player_id, avg(x) as x, avg(y) as y, count(*) as touches from np
        group by match_id, team_id, passer)
select match_id, team_id, player_id, round(x, 6) as x, round(y, 6) as y, touches,
  round(120 + 900 * touches / max(touches) over (partition by match_id, team_id), 6) as node_size from n"""))
def q_nodes(spark, sf):
    ev = pitch_events(spark, sf)
    return round_doubles(reports.pass_network_nodes(ev.where(F.col("type_name") == "Pass")))


@register("pass_network_edges", oracle(_PASSES + """
, e as (select match_id, team_id, passer, receiver, count(*) as pass_count from np
        group by match_id, team_id, passer, receiver),
nd as (select distinct match_id, team_id, passer from np),
k as (select * from e where exists (select 1 from nd where nd.match_id = e.match_id and nd.team_id = e.team_id
                                    and nd.passer = e.passer)
                        and exists (select 1 from nd where nd.match_id = e.match_id and nd.team_id = e.team_id
                                    and nd.passer = e.receiver))
select *, round(0.5 + 3 * pass_count / max(pass_count) over (partition by match_id, team_id), 6) as edge_width
from k"""))
def q_edges(spark, sf):
    ev = pitch_events(spark, sf)
    return round_doubles(reports.pass_network_edges(ev.where(F.col("type_name") == "Pass")))


@register("defensive_actions_by_type", oracle("""
select match_id, team_id, type_name, count(*) as actions, round(avg(location_x), 6) as mean_x,
  round(avg(location_y), 6) as mean_y
from pitch where type_name in ('Pressure', 'Duel', 'Interception', 'Block', 'Ball Recovery', 'Clearance',
  'Foul Committed') and location_x >= 60 and location_y is not null
group by match_id, team_id, type_name"""))
def q_def_by_type(spark, sf):
    acts = tactical.defensive_actions_in_opposition_half(pitch_events(spark, sf))
    return round_doubles(reports.defensive_actions_by_type(acts))


@register("teams_for_match", oracle("""
, t as (select match_id, home_team_id as team_id from dim_match union select match_id, away_team_id from dim_match)
select t.match_id, t.team_id, coalesce(d.team_name, cast(t.team_id as varchar)) as team_name
from t left join dim_team d on t.team_id = d.team_id where t.team_id is not null"""))
def q_teams_for_match(spark, sf):
    ev = pitch_events(spark, sf)
    dims = pitch_dims(spark, ev)
    return views.teams_for_matches(dims["dim_match"], ev, None, dims["dim_team"])


@register("players_for_match", oracle("""
, p as (select match_id, player_id, min(team_id) as team_id from pitch where player_id is not null
        group by match_id, player_id)
select p.match_id, p.player_id, p.team_id, coalesce(dp.player_name, cast(p.player_id as varchar)) as player_name,
  dt.team_name
from p left join dim_player dp on p.player_id = dp.player_id left join dim_team dt on p.team_id = dt.team_id"""))
def q_players_for_match(spark, sf):
    ev = pitch_events(spark, sf)
    dims = pitch_dims(spark, ev)
    return views.players_for_matches(ev.drop("player_name") if "player_name" in ev.columns else ev, None,
                                     dims["dim_player"], dims["dim_team"])


@register("events_view", oracle("""
select p.event_id, p.match_id, round(p.location_x, 6) as x, round(p.location_y, 6) as y,
  round(p.shot_statsbomb_xg, 6) as xg, t.team_name, pl.player_name
from pitch p left join dim_team t on p.team_id = t.team_id left join dim_player pl on p.player_id = pl.player_id"""))
def q_events_view(spark, sf):
    ev = pitch_events(spark, sf)
    dims = pitch_dims(spark, ev)
    v = views.events_view(ev, dims["dim_team"], dims["dim_player"], dims_unique=True)
    return round_doubles(v.select("event_id", "match_id", "x", "y", "xg", "team_name", "player_name"))


@register("enriched_matches", oracle("""
select m.match_id, m.competition_id, m.season_id, m.home_team_id, m.away_team_id, h.team_name as home_team_name,
  a.team_name as away_team_name
from dim_match m left join dim_team h on m.home_team_id = h.team_id left join dim_team a on m.away_team_id = a.team_id"""))
def q_enriched(spark, sf):
    ev = pitch_events(spark, sf)
    dims = pitch_dims(spark, ev)
    out = views.enrich_dim_match(dims["dim_match"], dims["dim_team"])
    return out.select("match_id", "competition_id", "season_id", "home_team_id", "away_team_id", "home_team_name",
                      "away_team_name")


@register("matches_by_competition", oracle("""
select match_id, competition_id, season_id, home_team_id, away_team_id,
  cast(home_team_id as varchar) || ' vs ' || cast(away_team_id as varchar) as match_label
from dim_match where competition_id = 1 and season_id = 101"""))
def q_matches_list(spark, sf):
    ev = pitch_events(spark, sf)
    dm = pitch_dims(spark, ev)["dim_match"].withColumns({
        "home_team_name": F.col("home_team_id").cast("string"), "away_team_name": F.col("away_team_id").cast("string")})
    out = views.matches_list(dm, competition_id=1, season_id=101)
    return out.select("match_id", "competition_id", "season_id", "home_team_id", "away_team_id", "match_label")


@register("team_events_by_name", oracle("""
select p.event_id, p.match_id, p.team_id from pitch p join dim_team t on p.team_id = t.team_id
where lower(trim(t.team_name)) = 'team 3'"""))
def q_team_filter(spark, sf):
    ev = pitch_events(spark, sf)
    dims = pitch_dims(spark, ev)
    v = views.events_view(ev, dims["dim_team"], dims["dim_player"])
    return views.team_filter(v, team_name=" TEAM 3 ").select("event_id", "match_id", "team_id")


@register("top_shots_table", oracle(_SHOTS_SQL + """
select event_id, match_id, round(xg, 6) as xg, shot_outcome from sv
order by xg desc nulls last, event_id limit 200"""))
def q_top_rows(spark, sf):
    sv, _, _ = shots_view(spark, sf)
    top = views.top_rows(sv, [F.col("xg").desc_nulls_last(), F.col("event_id")], 200)
    return round_doubles(top.select("event_id", "match_id", "xg", "shot_outcome"))


@register("season_choices", oracle("""
select distinct season_id from dim_match where competition_id = 2"""))
def q_cascade(spark, sf):
    ev = pitch_events(spark, sf)
    return views.cascade_choices(pitch_dims(spark, ev)["dim_match"], competition_id=2)["seasons"]


# The levels below the match, and those above, from one pass.
_CHOICES_SQL = """
, meta as (select match_id, competition_id, season_id, 'Home ' || cast(home_team_id as varchar) || ' vs Away ' || cast(away_team_id as varchar) as label from dim_match)
"""


def _levels(spark, sf):
    ev = pitch_events(spark, sf)
    dims = pitch_dims(spark, ev)
    dm = dims["dim_match"].withColumns({
        "match_label": F.concat(F.lit("Home "), F.col("home_team_id").cast("string"), F.lit(" vs Away "), F.col("away_team_id").cast("string")),
        "competition_name": F.when(F.col("competition_id") != 3, F.concat(F.lit("Cup "), F.col("match_id").cast("string")))})
    return views.cascade_levels(dm, ev, None, dims["dim_team"], dims["dim_player"].where("player_id % 3 <> 0"))


@register("choices_teams", oracle(_CHOICES_SQL + """
select 'team' as level, m.competition_id, m.season_id, m.match_id, t.team_id, cast(null as bigint) as player_id, t.team_name as label
from meta m join dim_match d on d.match_id = m.match_id join dim_team t on t.team_id = d.home_team_id or t.team_id = d.away_team_id"""))
def q_choices_teams(spark, sf):
    return _levels(spark, sf).where("level = 'team'")


@register("choices_players", oracle(_CHOICES_SQL + """
, pl as (select distinct match_id, team_id, player_id from pitch where player_id is not null)
select 'player' as level, m.competition_id, m.season_id, m.match_id, p.team_id, p.player_id,
  case when p.player_id % 3 <> 0 then 'Player ' else '' end || cast(p.player_id as varchar) as label
from pl p join meta m on m.match_id = p.match_id"""))
def q_choices_players(spark, sf):
    return _levels(spark, sf).where("level = 'player'")


@register("choices_matches", oracle(_CHOICES_SQL + """
select 'competition' as level, competition_id, cast(null as bigint) as season_id, cast(null as bigint) as match_id, cast(null as bigint) as team_id,
  cast(null as bigint) as player_id, case when competition_id <> 3 then 'Cup ' || cast(min(match_id) as varchar) else '3' end as label from meta group by competition_id
union all select 'season', competition_id, season_id, null, null, null, cast(season_id as varchar) from (select distinct competition_id, season_id from meta)
union all select 'match', competition_id, season_id, match_id, null, null, label from meta"""))
def q_choices_matches(spark, sf):
    return _levels(spark, sf).where("level in ('competition', 'season', 'match')")


# D3: the first row of each key as the file has it, among rows that conflict.
@register("lookup_first_name", """
select user_id, arg_min(event_type, event_id) as event_type from events where user_id is not null group by user_id""")
def q_lookup_first(spark, sf):
    return views.lookup_names(read_source(spark, sf, "events"), "user_id", "event_type")


# From the visible areas, or from the three-sixty rows if there are none.
@register("available_360", oracle("""
select 'areas' as source, match_id from pitch where event_index % 50 = 0 and match_id % 3 = 0 group by match_id
union all select 'rows', match_id from pitch where event_index % 50 = 0 and match_id % 2 = 0 group by match_id"""))
def q_available_360(spark, sf):
    ev = pitch_events(spark, sf).where("event_index % 50 = 0").select("match_id")
    areas, rows = ev.where("match_id % 3 = 0"), ev.where("match_id % 2 = 0")
    some = model.three_sixty_match_ids(areas, rows).select(F.lit("areas").alias("source"), "match_id")
    none = model.three_sixty_match_ids(areas.where("match_id < 0"), rows).select(F.lit("rows").alias("source"), "match_id")
    return some.unionByName(none)
