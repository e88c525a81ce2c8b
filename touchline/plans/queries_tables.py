"""Driver queries for table-agnostic operators (quality, validation, sampling,
JSON flattening, lineups) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import lineups, model, quality, reports, sample, views
from touchline.plans.catalog import oracle, pitch_dims, pitch_events, register, round_doubles
from touchline.sources.fixtures import read_source
from touchline.sources.flatten import flatten_json_column


def _t(spark, sf, name):
    return read_source(spark, sf, name)


@register("fk_violations", """
select 'lineitem.l_orderkey' as "check", count(*) as violations from lineitem l
  where l.l_orderkey is not null and not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey)
union all select 'lineitem.l_partkey', count(*) from lineitem l
  where l.l_partkey is not null and not exists (select 1 from part p where p.p_partkey = l.l_partkey)
union all select 'lineitem.l_suppkey', count(*) from lineitem l
  where l.l_suppkey is not null and not exists (select 1 from supplier s where s.s_suppkey = l.l_suppkey)""")
def q_fk(spark, sf):
    li = _t(spark, sf, "lineitem")
    return quality.fk_violations(li, [("l_orderkey", _t(spark, sf, "orders"), "o_orderkey"),
                                      ("l_partkey", _t(spark, sf, "part"), "p_partkey"),
                                      ("l_suppkey", _t(spark, sf, "supplier"), "s_suppkey")], "lineitem")


@register("orders_fk_violations", """
select 'orders.o_custkey' as "check", count(*) as violations from orders o
where o.o_custkey is not null and not exists (select 1 from customer c where c.c_custkey = o.o_custkey)""")
def q_fk_orders(spark, sf):
    return quality.fk_violations(_t(spark, sf, "orders"), [("o_custkey", _t(spark, sf, "customer"), "c_custkey")],
                                 "orders")


@register("key_null_rates", """
select 'lineitem' as "table", c as "column", cast(n as bigint) as null_rows, cast(t as bigint) as checked_rows,
  printf('%.2f%%', n * 100.0 / t) as null_rate from (
  select 'l_orderkey' as c, count(*) filter (where l_orderkey is null) as n, count(*) as t from lineitem
  union all select 'l_partkey', count(*) filter (where l_partkey is null), count(*) from lineitem
  union all select 'l_returnflag', count(*) filter (where l_returnflag is null or trim(l_returnflag) = ''),
                   count(*) from lineitem)
union all select 'lineitem', 'l_missing', null, null, 'column missing'""")
def q_null_rates(spark, sf):
    return quality.key_null_rates(_t(spark, sf, "lineitem"), "lineitem",
                                  ["l_orderkey", "l_partkey", "l_returnflag", "l_missing"])


@register("duplicate_line_keys", """
select count(*) as duplicate_keys, cast(coalesce(sum(n - 1), 0) as bigint) as duplicate_rows from (
  select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1)""")
def q_dup_lines(spark, sf):
    return model.duplicate_extra_rows(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("duplicate_dim_keys", """
select 'customer' as dim, count(*) as duplicate_keys from (select c_custkey from customer group by 1 having count(*) > 1)
union all select 'nation', count(*) from (select n_nationkey from nation group by 1 having count(*) > 1)
union all select 'part', count(*) from (select p_partkey from part group by 1 having count(*) > 1)
union all select 'lineitem_orders', count(*) from (select l_orderkey from lineitem group by 1 having count(*) > 1)""")
def q_dup_dims(spark, sf):
    return quality.duplicate_dim_keys({"customer": (_t(spark, sf, "customer"), "c_custkey"),
                                       "nation": (_t(spark, sf, "nation"), "n_nationkey"),
                                       "part": (_t(spark, sf, "part"), "p_partkey"),
                                       "lineitem_orders": (_t(spark, sf, "lineitem"), "l_orderkey")})


@register("row_counts", """
select 'orders' as "table", count(*) as "rows" from orders union all select 'lineitem', count(*) from lineitem
union all select 'customer', count(*) from customer""")
def q_row_counts(spark, sf):
    return quality.row_counts({n: _t(spark, sf, n) for n in ("orders", "lineitem", "customer")})


@register("latest_orders_per_customer", """
select o_custkey, o_orderkey, cast(o_orderdate as date) as o_orderdate from orders
qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3""")
def q_latest_orders(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    top = reports.latest_per_group(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3)
    return top.withColumn("o_orderdate", F.to_date("o_orderdate"))


@register("sample_lineitems_latest_orders", """
with latest as (select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 50)
select l_orderkey, l_linenumber, round(l_quantity, 6) as l_quantity from lineitem
where l_orderkey in (select o_orderkey from latest)""")
def q_sample_semi(spark, sf):
    o = _t(spark, sf, "orders")
    latest = o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(50) \
              .select(F.col("o_orderkey").alias("match_id"))
    li = _t(spark, sf, "lineitem").withColumn("match_id", F.col("l_orderkey"))
    out = sample.restrict_to_matches(li, latest)
    return round_doubles(out.select("l_orderkey", "l_linenumber", "l_quantity"))


@register("sample_id_union", """
with latest as (select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey desc limit 50),
li as (select * from lineitem where l_orderkey in (select o_orderkey from latest))
select distinct id from (select l_suppkey as id from li union select l_partkey from li) where id is not null""")
def q_sample_ids(spark, sf):
    o = _t(spark, sf, "orders")
    latest = o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(50) \
              .select(F.col("o_orderkey").alias("match_id"))
    li = sample.restrict_to_matches(_t(spark, sf, "lineitem").withColumn("match_id", F.col("l_orderkey")), latest)
    return sample.id_set([(li, ("l_suppkey", "l_partkey"))], "id")


@register("flatten_props", """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as props_k from events""")
def q_flatten(spark, sf):
    ev = _t(spark, sf, "events").select("event_id", "props")
    return flatten_json_column(ev, "props", "k bigint", keep=["event_id"])


# -------------------------- lineups over the pitch projection ---------------

_XI_SQL = """,
firsts as (select match_id, team_id, player_id, period, minute, second, event_index, event_id from pitch
           where player_id is not null
           qualify row_number() over (partition by match_id, team_id, player_id
                                      order by period, minute, second, event_index, event_id) = 1),
xi as (select match_id, team_id, player_id, row_number() over (partition by match_id, team_id
                        order by period, minute, second, event_index, event_id) as sort_order from firsts
       qualify sort_order <= 11)
"""


@register("starting_xi_events", oracle(_XI_SQL + """
select match_id, team_id, player_id, 'Player ' || cast(sort_order as varchar) as player_name,
  cast(sort_order as int) as sort_order from xi"""))
def q_xi(spark, sf):
    xi = lineups.xi_from_events(pitch_events(spark, sf))
    return xi.select("match_id", "team_id", "player_id", "player_name", F.col("sort_order").cast("int"))


@register("xi_warnings", oracle(_XI_SQL + """
select match_id, team_id, count(*) as players, count(distinct 'Player ' || cast(sort_order as varchar))
  as distinct_names, count(*) <> 11 as size_warning, false as duplicate_names
from xi group by match_id, team_id"""))
def q_xi_warn(spark, sf):
    return lineups.xi_warnings(lineups.xi_from_events(pitch_events(spark, sf)))


@register("starting_positions", oracle(_XI_SQL + """
select x.match_id, x.team_id, x.player_id, cast(60.0 as double) as x,
  cast(case when x.team_id = m.home_team_id then 34.0 else 66.0 end as double) as y, true as approximate,
  '?' as jersey_text
from xi x left join dim_match m on x.match_id = m.match_id"""))
def q_positions(spark, sf):
    ev = pitch_events(spark, sf)
    xi = lineups.xi_from_events(ev)
    pos = lineups.starting_positions(xi, pitch_dims(spark, ev)["dim_match"])
    return round_doubles(pos.select("match_id", "team_id", "player_id", "x", "y", "approximate", "jersey_text"))


# -------------------------- validation over the pitch fact_shots -------------

@register("shot_fk_checks", oracle("""
, fs as (select * from pitch where type_name = 'Shot')
select 'fact_shots.match_id' as "check", count(*) as violations from fs
  where match_id is not null and match_id not in (select match_id from dim_match)
union all select 'fact_shots.team_id', count(*) from fs
  where team_id is not null and team_id not in (select team_id from dim_team)
union all select 'fact_shots.player_id', count(*) from fs
  where player_id is not null and player_id not in (select player_id from dim_player)"""))
def q_shot_fk(spark, sf):
    ev = pitch_events(spark, sf)
    d = pitch_dims(spark, ev)
    fs = model.fact_shots(ev, F.struct("match_id", "event_index"))
    return quality.fk_violations(fs, [("match_id", d["dim_match"], "match_id"), ("team_id", d["dim_team"], "team_id"),
                                      ("player_id", d["dim_player"], "player_id")], "fact_shots")


@register("shot_null_ids", oracle("""
, fs as (select * from pitch where type_name = 'Shot')
select (select count(*) from fs) as "rows", "column", null_ids from (
  select 'shot_outcome_id' as "column", count(*) filter (where shot_outcome_id is null) as null_ids from fs
  union all select 'body_part_id', count(*) filter (where body_part_id is null) from fs
  union all select 'shot_type_id', count(*) filter (where shot_type_id is null) from fs)"""))
def q_shot_nulls(spark, sf):
    ev = pitch_events(spark, sf)
    return quality.null_id_counts(model.fact_shots(ev, F.struct("match_id", "event_index")))


@register("goal_consistency", oracle("""
, fs as (select * from pitch where type_name = 'Shot')
select cast(count(*) filter (where lower(trim(coalesce(o.shot_outcome_name, ''))) = 'goal') as bigint)
         as goals_by_name,
       count(*) filter (where fs.shot_outcome_id in (select shot_outcome_id from dim_shot_outcome
                                                     where lower(trim(shot_outcome_name)) = 'goal')) as goals_by_id
from fs left join dim_shot_outcome o on fs.shot_outcome_id = o.shot_outcome_id"""))
def q_goal_consistency(spark, sf):
    ev = pitch_events(spark, sf)
    d = pitch_dims(spark, ev)
    return quality.goal_consistency(model.fact_shots(ev, F.struct("match_id", "event_index")), d["dim_shot_outcome"])


# Q11 where names and ids disagree: outcomes as the events name them, some twice.
_NAMED_OUTCOMES = """, named as (select shot_outcome_id, case when shot_outcome_id = 97 then ' GOAL ' when shot_outcome_id = 98 and body_part_id = 38 then 'Goal'
  else 'Other' end as shot_outcome_name from pitch where shot_outcome_id is not null and shot_outcome_id <> 101 group by 1, 2)
"""


def _named_outcomes(ev):
    name = F.when(F.col("shot_outcome_id") == 97, " GOAL ").when((F.col("shot_outcome_id") == 98) & (F.col("body_part_id") == 38), "Goal").otherwise("Other")
    return ev.where("shot_outcome_id is not null and shot_outcome_id <> 101").select("shot_outcome_id", name.alias("shot_outcome_name")).distinct()


@register("goal_inconsistency", oracle(_NAMED_OUTCOMES + """
, fs as (select * from pitch where type_name = 'Shot')
select cast(sum(case when lower(trim(n.shot_outcome_name)) = 'goal' then 1 else 0 end) as bigint) as goals_by_name,
  (select count(*) from fs where shot_outcome_id in (select shot_outcome_id from named where lower(trim(shot_outcome_name)) = 'goal')) as goals_by_id
from fs left join (select * from named union all select shot_outcome_id, 'goal' from named where shot_outcome_id = 97) n on n.shot_outcome_id = fs.shot_outcome_id"""))
def q_goal_inconsistency(spark, sf):
    ev = pitch_events(spark, sf)
    named = _named_outcomes(ev)
    twice = named.unionByName(named.where("shot_outcome_id = 97").withColumn("shot_outcome_name", F.lit("goal")))
    return quality.goal_consistency(model.fact_shots(ev, F.struct("match_id", "event_index")), twice)


# An outcome without a row (101), and one whose label is blank.
@register("missing_outcome_labels", oracle("""
, d as (select shot_outcome_id, case when shot_outcome_id = 99 then ' ' else shot_outcome_name end as n from dim_shot_outcome where shot_outcome_id <> 101)
select count(*) as missing_labels from pitch p left join d on d.shot_outcome_id = p.shot_outcome_id
where p.type_name = 'Shot' and p.shot_outcome_id is not null and trim(coalesce(d.n, '')) = ''"""))
def q_missing_outcome_labels(spark, sf):
    ev = pitch_events(spark, sf)
    dim = pitch_dims(spark, ev)["dim_shot_outcome"].where("shot_outcome_id <> 101")
    dim = dim.withColumn("shot_outcome_name", F.when(F.col("shot_outcome_id") == 99, " ").otherwise(F.col("shot_outcome_name")))
    return quality.missing_outcome_labels(model.fact_shots(ev, F.struct("match_id", "event_index")), dim)


# J8 with ids that the dimensions lack.
@register("shot_fk_violations", oracle("""
, fs as (select * from pitch where type_name = 'Shot')
select 'fact_shots.match_id' as "check", count(*) filter (where match_id % 7 = 3) as violations from fs
union all select 'fact_shots.team_id', count(*) filter (where team_id % 5 = 2) from fs
union all select 'fact_shots.player_id', count(*) filter (where player_id % 11 = 4) from fs"""))
def q_shot_fk_violations(spark, sf):
    ev = pitch_events(spark, sf)
    d = pitch_dims(spark, ev)
    fs = model.fact_shots(ev, F.struct("match_id", "event_index"))
    return quality.fk_violations(fs, [("match_id", d["dim_match"].where("match_id % 7 <> 3"), "match_id"), ("team_id", d["dim_team"].where("team_id % 5 <> 2"), "team_id"),
                                      ("player_id", d["dim_player"].where("player_id % 11 <> 4"), "player_id")], "fact_shots")


# Q12: all checks of a model whose dimensions have gaps.
@register("validate_model", oracle(_NAMED_OUTCOMES + """
, fs as (select * from pitch where type_name = 'Shot'),
c as (select 'fact_shots unique (match_id, event_id)' as "check", cast(0 as bigint) as value
  union all select * from (values ('has shot_outcome_id', 0), ('has body_part_id', 0), ('has shot_type_id', 0), ('no shot_outcome', 0), ('no shot_outcome_name', 0), ('no shot_type', 0),
    ('no shot_type_name', 0), ('no body_part', 0), ('no body_part_name', 0)) t(a, b)
  union all select 'outcome labels available', count(*) filter (where shot_outcome_id = 101) from fs
  union all select 'fk fact_shots.match_id', 0
  union all select 'fk fact_shots.team_id', count(*) filter (where team_id % 5 = 2) from fs
  union all select 'fk fact_shots.player_id', 0
  union all select 'shot_outcome_id populated', count(*) filter (where shot_outcome_id is null) from fs
  union all select 'body_part_id populated', count(*) filter (where body_part_id is null) from fs
  union all select 'goal name/id consistency', abs(sum(case when lower(trim(n.shot_outcome_name)) = 'goal' then 1 else 0 end)
      - (select count(*) from fs where shot_outcome_id in (select shot_outcome_id from named where lower(trim(shot_outcome_name)) = 'goal')))
    from fs left join named n on n.shot_outcome_id = fs.shot_outcome_id)
select "check", cast(value as bigint) as value, case when value = 0 then 'PASS' else 'FAIL' end as status from c
union all select 'overall', count(*) filter (where value <> 0), case when count(*) filter (where value <> 0) = 0 then 'PASS' else 'FAIL' end from c"""))
def q_validate_model(spark, sf):
    ev = pitch_events(spark, sf)
    d = pitch_dims(spark, ev)
    fs = model.fact_shots(ev, F.struct("match_id", "event_index"))
    return quality.validate_model(spark, {**d, "fact_shots": fs, "dim_team": d["dim_team"].where("team_id % 5 <> 2"), "dim_shot_outcome": _named_outcomes(ev)})


@register("missing_body_part_labels", oracle("""
select count(*) filter (where p.body_part_id is not null and b.body_part_name is null) as missing_labels
from pitch p left join dim_body_part b on p.body_part_id = b.body_part_id where p.type_name = 'Shot'"""))
def q_missing_labels(spark, sf):
    ev = pitch_events(spark, sf)
    d = pitch_dims(spark, ev)
    fs = model.fact_shots(ev, F.struct("match_id", "event_index"))
    dim = d["dim_body_part"].withColumnRenamed("body_part_id", "shot_outcome_id") \
                            .withColumnRenamed("body_part_name", "shot_outcome_name")
    return quality.missing_outcome_labels(fs.drop("shot_outcome_id").withColumnRenamed("body_part_id",
                                                                                        "shot_outcome_id"), dim)


@register("goals_vs_score", oracle("""
, g as (select match_id, team_id, count(*) filter (where shot_outcome_id = 97) as goals from pitch
        where type_name = 'Shot' and team_id is not null group by match_id, team_id),
s as (select m.match_id, coalesce(h.goals, 0) as goals_home, coalesce(a.goals, 0) as goals_away,
  case when m.match_id % 5 <> 4 then coalesce(h.goals, 0) + case when m.match_id % 3 = 1 then 1 else 0 end end as home_score, coalesce(a.goals, 0) as away_score
  from dim_match m left join g h on h.match_id = m.match_id and h.team_id = m.home_team_id
  left join g a on a.match_id = m.match_id and a.team_id = m.away_team_id)
select *, coalesce(goals_home = home_score, false) and goals_away = away_score as consistent from s"""))
def q_goals_vs_score(spark, sf):
    """Scores counted from the events themselves, one too many in every third match, unknown in every fifth."""
    from touchline.plans.queries_reports import shots_view
    sv, ev, dims = shots_view(spark, sf)
    goals = ev.where("type_name = 'Shot' and shot_outcome_id = 97").groupBy("match_id", "team_id").agg(F.count("*").alias("n"))
    dm = dims["dim_match"]
    for side in ("home", "away"):
        counted = goals.select("match_id", F.col("team_id").alias(f"{side}_team_id"), F.col("n").alias(f"{side}_score"))
        dm = dm.join(counted, ["match_id", f"{side}_team_id"], "left").fillna(0, [f"{side}_score"])
    one_more = F.col("home_score") + (F.col("match_id") % 3 == 1).cast("int")
    dm = dm.withColumn("home_score", F.when(F.col("match_id") % 5 != 4, one_more))
    return reports.goals_consistency(reports.match_stats(ev, sv, dm))


@register("stat_bar_shares", oracle("""
, per as (select match_id, team_id, count(*) as shots from pitch where type_name = 'Shot' and team_id is not null
          group by match_id, team_id),
j as (select m.match_id, cast(coalesce(h.shots, 0) as double) as l, cast(coalesce(a.shots, 0) as double) as r
      from dim_match m left join per h on h.match_id = m.match_id and h.team_id = m.home_team_id
      left join per a on a.match_id = m.match_id and a.team_id = m.away_team_id)
select match_id, round(case when l + r > 0 then l / (l + r) * 100 else 50.0 end, 6) as shots_home_pct,
  round(case when l + r > 0 then r / (l + r) * 100 else 50.0 end, 6) as shots_away_pct from j"""))
def q_shares(spark, sf):
    from touchline.plans.queries_reports import shots_view
    sv, ev, dims = shots_view(spark, sf)
    return round_doubles(reports.stat_bar_shares(reports.match_stats(ev, sv, dims["dim_match"]), "shots"))


@register("lineup_slice", oracle("""
select event_id, event_index, match_id, team_id, player_id, minute, second, period, type_name
from pitch where match_id = 3"""))
def q_lineup_slice(spark, sf):
    return views.lineup_events(pitch_events(spark, sf), match_id=3)


# -------------------------- positions (P17, P18, W8, J12) ---------------------
# Position names are derived from the player id over the 25 mapped names plus
# one unmapped name, so the XI built from events carries positions.

def _position_names() -> list[str]:
    return [name.title() for name, _, _ in lineups.POSITION_COORDS] + ["Mystery Role"]


def _position_expr():
    names = _position_names()
    return F.element_at(F.array(*[F.lit(n) for n in names]),
                        (F.col("player_id") % len(names) + 1).cast("int"))


def _position_sql() -> str:
    names = _position_names()
    arr = "[" + ", ".join("'" + n + "'" for n in names) + "]"
    coords = ", ".join(f"('{k}', {x}, {y})" for k, x, y in lineups.POSITION_COORDS)
    return f""",
named as (select x.*, {arr}[cast(x.player_id % {len(names)} as int) + 1] as position_name from xi x),
coords as (select * from (values {coords}) t(pos_key, x_up, y_up))
"""


@register("starting_positions_named", oracle(_XI_SQL + _position_sql() + """
select n.match_id, n.team_id, n.player_id, n.position_name,
  cast(coalesce(c.x_up, 60.0) as double) as x,
  cast(case when n.team_id = m.home_team_id then 100.0 - coalesce(c.y_up, 66.0) else coalesce(c.y_up, 66.0) end
       as double) as y,
  c.x_up is null as approximate
from named n left join coords c on lower(trim(n.position_name)) = c.pos_key
left join dim_match m on n.match_id = m.match_id"""))
def q_positions_named(spark, sf):
    ev = pitch_events(spark, sf)
    xi = lineups.xi_from_events(ev.withColumn("position_name", _position_expr()))
    pos = lineups.starting_positions(xi, pitch_dims(spark, ev)["dim_match"])
    return round_doubles(pos.select("match_id", "team_id", "player_id", "position_name", "x", "y", "approximate"))


@register("unmapped_positions", oracle(_XI_SQL + _position_sql() + """
select distinct n.match_id, n.team_id, n.position_name from named n
left join coords c on lower(trim(n.position_name)) = c.pos_key where c.pos_key is null"""))
def q_unmapped(spark, sf):
    ev = pitch_events(spark, sf)
    xi = lineups.xi_from_events(ev.withColumn("position_name", _position_expr()))
    return lineups.unmapped_positions(xi)


# -------------------------- dimension precedence (A16, A17) ------------------
# Three name sources derived from the projection: a teams table (one row per
# event team, 'Team n'), the matches (home/away names, blank for every third
# match) and lineup rows (one per event player, blank names for some players).

_PRECEDENCE_SQL = """,
teams_src as (select team_id, 'Team ' || cast(team_id as varchar) as team_name, event_id as o from pitch
              where team_id is not null),
match_src as (select match_id, home_team_id, away_team_id,
                case when match_id % 3 = 0 then '' else 'Home side ' || cast(home_team_id as varchar) end as hn,
                'Away side ' || cast(away_team_id as varchar) as an, event_id as o from pitch),
lineup_src as (select team_id, case when player_id % 4 = 0 then '' else 'Lineup ' || cast(team_id as varchar) end
                 as team_name, player_id, case when player_id % 5 = 0 then '' else 'Player ' || cast(player_id as varchar)
                 end as player_name, event_id as o from pitch where team_id is not null),
t1 as (select team_id, arg_max(team_name, o) as teams_name from teams_src group by team_id),
m1 as (select match_id, min(o) as first_o, arg_max(home_team_id, o) as h, arg_max(away_team_id, o) as a,
              arg_max(hn, o) as hn, arg_max(an, o) as an from match_src group by match_id),
m2 as (select team_id, arg_max(name, (first_o, side)) as matches_name from (
         select h as team_id, hn as name, first_o, 0 as side from m1
         union all select a, an, first_o, 1 from m1) where team_id is not null group by team_id),
l1 as (select team_id, arg_min(team_name, o) filter (where team_name <> '') as lineup_name from lineup_src
       group by team_id),
ids as (select team_id from t1 union select team_id from m2 union select team_id from l1)
"""


def _precedence_frames(spark, sf):
    ev = pitch_events(spark, sf).withColumn("o", F.col("event_id"))
    teams = ev.where(F.col("team_id").isNotNull()).select(
        "team_id", F.concat(F.lit("Team "), F.col("team_id").cast("string")).alias("team_name"), F.col("o").alias("_ord"))
    matches = ev.select(
        "match_id", "home_team_id", "away_team_id",
        F.when(F.col("match_id") % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit("Home side "), F.col("home_team_id").cast("string"))).alias("home_team_name"),
        F.concat(F.lit("Away side "), F.col("away_team_id").cast("string")).alias("away_team_name"),
        F.col("o").alias("_ord"))
    lineups_src = ev.where(F.col("team_id").isNotNull()).select(
        "team_id", F.when(F.col("player_id") % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit("Lineup "), F.col("team_id").cast("string"))).alias("team_name"),
        "player_id", F.when(F.col("player_id") % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("Player "), F.col("player_id").cast("string"))).alias("player_name"),
        F.col("o").alias("_ord"))
    return teams, matches, lineups_src


@register("dim_team_precedence", oracle(_PRECEDENCE_SQL + """
select ids.team_id,
  case when coalesce(coalesce(m2.matches_name, t1.teams_name), '') = ''
       then coalesce(l1.lineup_name, coalesce(m2.matches_name, t1.teams_name), '')
       else coalesce(m2.matches_name, t1.teams_name) end as team_name
from ids left join t1 on t1.team_id = ids.team_id left join m2 on m2.team_id = ids.team_id
left join l1 on l1.team_id = ids.team_id"""))
def q_dim_team_precedence(spark, sf):
    teams, matches, lineups_src = _precedence_frames(spark, sf)
    return model.dim_team(teams, matches, lineups_src)


@register("dim_player_precedence", oracle("""
, num as (select *, cast(substr(event_id, 2) as bigint) as o from pitch where player_id is not null),
players_src as (select player_id, case when player_id % 5 = 0 then '' else 'P' || cast(player_id as varchar) end
                  as player_name, case when o % 2 = 0 then team_id end as team_id, o from num),
lineup_src as (select player_id, case when player_id % 3 = 0 then '' else 'Lineup ' || cast(player_id as varchar) end
                 as player_name, team_id, o from num),
p0 as (select player_id, arg_max({'n': player_name, 't': team_id}, o) as r from players_src group by player_id),
p1 as (select player_id, r.n as base_name, r.t as base_team from p0),
l1 as (select player_id, arg_min(player_name, o) filter (where player_name <> '') as lineup_name,
              arg_min(team_id, o) filter (where team_id is not null) as lineup_team from lineup_src group by player_id)
select coalesce(p1.player_id, l1.player_id) as player_id,
  case when coalesce(p1.base_name, '') <> '' then p1.base_name else coalesce(l1.lineup_name, '') end as player_name,
  coalesce(p1.base_team, l1.lineup_team) as team_id
from p1 full join l1 on p1.player_id = l1.player_id"""))
def q_dim_player_precedence(spark, sf):
    ev = pitch_events(spark, sf).where(F.col("player_id").isNotNull())
    players = ev.select(
        "player_id", F.when(F.col("player_id") % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("P"), F.col("player_id").cast("string"))).alias("player_name"),
        F.when(F.col("event_id").substr(2, 20).cast("bigint") % 2 == 0, F.col("team_id")).alias("team_id"),
        F.col("event_id").substr(2, 20).cast("bigint").alias("_ord"))
    lineups_src = ev.select(
        "player_id", F.when(F.col("player_id") % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit("Lineup "), F.col("player_id").cast("string"))).alias("player_name"),
        "team_id", F.col("event_id").substr(2, 20).cast("bigint").alias("_ord"))
    return model.dim_player(players, lineups_src)


# M1: a name that is there exactly beats one that holds it; the newest matches with what they name.
@register("curated_sample", oracle("""
, chosen as (select 'exact' as sample, match_id from (select match_id from dim_match where competition_id = 2 and season_id = 101 order by match_id % 7 desc, match_id desc limit 3) a
  union all select 'within', match_id from (select match_id from dim_match where competition_id = 1 and season_id = 100 order by match_id % 7 desc, match_id desc limit 3) b),
rows_of as (select c.sample, p.* from chosen c join pitch p on p.match_id = c.match_id),
teams as (select sample, home_team_id as id from rows_of union select sample, away_team_id from rows_of union select sample, team_id from rows_of where team_id is not null)
select sample, 'dim_match' as "table", match_id as id from chosen
union all select sample, 'dim_team', id from teams
union all select distinct sample, 'dim_player', player_id from rows_of where player_id is not null
union all select sample, 'fact_events', cast(substr(event_id, 2) as bigint) from rows_of
union all select sample, 'fact_shots', cast(substr(event_id, 2) as bigint) from rows_of where type_name = 'Shot'"""))
def q_curated_sample(spark, sf):
    ev = pitch_events(spark, sf)
    d = pitch_dims(spark, ev)
    names = d["dim_match"].select("competition_id", "season_id").distinct()
    comp = F.when(F.col("competition_id") == 0, "Old Cup").when(F.col("competition_id") == 1, "Big Cup One").when(F.col("competition_id") == 2, " cup ")
    full = {**d, "dim_match": d["dim_match"].withColumn("match_date", F.concat(F.lit("2024-01-0"), (F.col("match_id") % 7).cast("string"))),
            "fact_events": ev, "fact_shots": ev.where("type_name = 'Shot'"),
            "dim_competition": names.select("competition_id", comp.alias("competition_name")).distinct(),
            "dim_season": names.select("season_id", F.concat(F.lit("S"), F.col("season_id").cast("string")).alias("season_name")).distinct()}
    out = None
    for label, competition, season in (("exact", "CUP", "s101 "), ("within", " cup one", "S100")):
        tables = sample.sample_tables(full, sample.curated_matches(full, competition, season, 3))
        for name, df in tables.items():
            key = F.expr("cast(substr(event_id, 2) as bigint)") if name.startswith("fact_") else F.col(df.columns[0])
            rows = df.select(F.lit(label).alias("sample"), F.lit(name).alias("table"), key.cast("bigint").alias("id"))
            out = rows if out is None else out.unionByName(rows)
    return out
