"""Driver queries for the star-schema layer (facts, dims, dedupe)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import model
from touchline.plans.catalog import oracle, pitch_dims, pitch_events, register, round_doubles
from touchline.sources.fixtures import read_source


def pitch_with_copies(spark, sf):
    """Projection plus a second copy of every event of matches with id % 5 = 0
    (the duplicate-delivery case the dedupe must remove)."""
    ev = pitch_events(spark, sf)
    return ev.unionByName(ev.where(F.col("match_id") % 5 == 0))


_COPIES_SQL = """,
src as (select * from pitch union all select * from pitch where match_id % 5 = 0),
firsts as (select * from src qualify row_number() over (partition by match_id, event_id order by event_index) = 1)
"""

_ZONE = ("case when location_x between 0 and 120 and location_y between 0 and 80 then "
         "cast(least(5, floor(location_x / 20)) + 6 * least(4, floor(location_y / 16)) as bigint) end")
_TKEY = "cast(period as bigint) * 100000 + cast(minute as bigint) * 100 + cast(second as bigint)"


@register("fact_events", oracle(_COPIES_SQL + f"""
select e.event_id, e.match_id, e.team_id, e.player_id, cast(e.type_id as bigint) as type_id, e.period, e.minute,
  e.second, round(e.location_x, 6) as location_x, round(e.location_y, 6) as location_y, e.event_index, e.type_name,
  e.pass_outcome_name, cast(e.shot_outcome_id as bigint) as shot_outcome_id,
  cast(e.shot_type_id as bigint) as shot_type_id, cast(e.body_part_id as bigint) as body_part_id,
  round(e.pass_end_location_x, 6) as pass_end_location_x, round(e.pass_end_location_y, 6) as pass_end_location_y,
  round(e.carry_end_location_x, 6) as carry_end_location_x, round(e.carry_end_location_y, 6) as carry_end_location_y,
  round(e.shot_statsbomb_xg, 6) as shot_statsbomb_xg, {_ZONE} as zone_id, {_TKEY} as time_key,
  m.competition_id, m.season_id
from firsts e left join dim_match m on e.match_id = m.match_id"""))
def q_fact_events(spark, sf):
    ev = pitch_with_copies(spark, sf)
    dims = pitch_dims(spark, pitch_events(spark, sf))
    out = model.fact_events(ev.drop("home_team_id", "away_team_id", "pass_recipient_id"), dims["dim_match"],
                            F.struct("match_id", "event_index"))
    return round_doubles(out)


@register("fact_shots", oracle(_COPIES_SQL + f"""
, ids as (select 16 as tid union select distinct cast(type_id as bigint) from src
          where lower(trim(type_name)) = 'shot' and type_id is not null)
select e.event_id, e.match_id, e.team_id, e.player_id, e.minute, e.second, e.period,
  round(e.location_x, 6) as location_x, round(e.location_y, 6) as location_y,
  cast(null as double) as shot_end_location_x, cast(null as double) as shot_end_location_y,
  round(e.shot_statsbomb_xg, 6) as shot_statsbomb_xg, cast(e.shot_outcome_id as bigint) as shot_outcome_id,
  cast(e.shot_type_id as bigint) as shot_type_id, cast(e.body_part_id as bigint) as body_part_id,
  cast(null as varchar) as under_pressure, {_ZONE} as zone_id, {_TKEY} as time_key
from firsts e where lower(trim(e.type_name)) = 'shot' or e.type_id in (select tid from ids)"""))
def q_fact_shots(spark, sf):
    ev = pitch_with_copies(spark, sf)
    return round_doubles(model.fact_shots(ev, F.struct("match_id", "event_index")))


@register("dim_time", oracle(f"""
, t as (select distinct period, minute, second from pitch
        where period is not null and minute is not null and second is not null),
m as (select *, cast(greatest((period - 1) * 45 + minute, 0) as bigint) as minute_absolute from t)
select {_TKEY} as time_key, period, minute, second, minute_absolute,
  cast(floor(minute_absolute / 5) * 5 as bigint) as time_bucket_5min,
  cast(floor(minute_absolute / 15) * 15 as bigint) as time_bucket_15min,
  cast(period = 1 as int) as is_first_half, cast(period = 2 as int) as is_second_half,
  cast(period >= 3 as int) as is_extra_time
from m"""))
def q_dim_time(spark, sf):
    return model.dim_time(pitch_events(spark, sf))


@register("zone_event_counts", oracle(f"""
, z as (select cast(i as bigint) as zone_id, cast(i % 6 as int) as zx, cast(i // 6 as int) as zy
        from range(30) r(i)),
zl as (select zone_id, zx as zone_x_index, zy as zone_y_index, zx * 20 as x_min, zx * 20 + 20 as x_max,
         zy * 16 as y_min, zy * 16 + 16 as y_max,
         'Zone ' || zone_id || ' (' ||
         ['Left Wing', 'Left Half-Space', 'Central', 'Right Half-Space', 'Right Wing'][zy + 1] || ' ' ||
         ['Defensive Sixth', 'Build-Up Sixth', 'Middle Sixth', 'Attacking Sixth', 'Final Third', 'Box Sixth'][zx + 1]
         || ')' as zone_label from z),
c as (select {_ZONE} as zone_id, count(*) as events, count(*) filter (where type_name = 'Shot') as shots
      from pitch group by 1)
select zl.*, coalesce(c.events, 0) as events, coalesce(c.shots, 0) as shots
from zl left join c on zl.zone_id = c.zone_id"""))
def q_zone_counts(spark, sf):
    from touchline.functions.pitch import zone_id
    ev = pitch_events(spark, sf)
    counts = (ev.select(zone_id(F.col("location_x"), F.col("location_y")).alias("zone_id"), "type_name")
                .groupBy("zone_id").agg(F.count(F.lit(1)).alias("events"),
                                        F.count_if(F.col("type_name") == "Shot").alias("shots")))
    z = model.dim_zone(spark)
    return (z.join(counts, "zone_id", "left")
             .fillna(0, subset=["events", "shots"]))


@register("small_dims", oracle("""
, s as (
  select 'dim_event_type' as dim, cast(type_id as bigint) as id, coalesce(nullif(trim(type_name), ''), '') as name,
         match_id, event_index from pitch
  union all select 'dim_shot_outcome', cast(shot_outcome_id as bigint), '', match_id, event_index from pitch
  union all select 'dim_shot_type', cast(shot_type_id as bigint), '', match_id, event_index from pitch
  union all select 'dim_body_part', cast(body_part_id as bigint), '', match_id, event_index from pitch)
select dim, id, coalesce(arg_min(name, (match_id, event_index)) filter (where name <> ''), '') as name
from s where id is not null group by dim, id"""))
def q_small_dims(spark, sf):
    return model.small_dims_stacked(pitch_events(spark, sf), F.struct("match_id", "event_index"))


@register("duplicate_event_keys", oracle("""
, src as (select * from pitch union all select * from pitch where match_id % 5 = 0),
g as (select match_id, event_id, count(*) as n from src group by match_id, event_id having count(*) > 1)
select count(*) as duplicate_keys, cast(coalesce(sum(n - 1), 0) as bigint) as duplicate_rows from g"""))
def q_duplicates(spark, sf):
    return model.duplicate_extra_rows(pitch_with_copies(spark, sf), ["match_id", "event_id"])


@register("dedupe_events", oracle("""
, src as (select * from pitch union all select * from pitch where match_id % 5 = 0)
select match_id, count(*) as events, count(distinct event_id) as distinct_events from (
  select * from src qualify row_number() over (partition by match_id, event_id order by event_index) = 1)
group by match_id"""))
def q_dedupe(spark, sf):
    d = model.dedupe_first(pitch_with_copies(spark, sf), ["match_id", "event_id"], F.struct("match_id", "event_index"))
    return d.groupBy("match_id").agg(F.count(F.lit(1)).alias("events"),
                                     F.countDistinct("event_id").alias("distinct_events"))


@register("first_order_per_customer", oracle("""
select o_custkey, o_orderkey, cast(o_orderdate as date) as o_orderdate, round(o_totalprice, 6) as o_totalprice
from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1"""))
def q_first_order(spark, sf):
    o = read_source(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    out = model.first_row_per_key(o.withColumn("_ord", F.struct("o_orderdate", "o_orderkey")), "o_custkey", "_ord")
    return round_doubles(out.drop("_ord").withColumn("o_orderdate", F.to_date("o_orderdate")))


@register("last_order_per_customer", oracle("""
select o_custkey, o_orderkey, cast(o_orderdate as date) as o_orderdate, o_orderstatus from orders
qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1"""))
def q_last_order(spark, sf):
    o = read_source(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    out = model.last_row_per_key(o.withColumn("_ord", F.struct("o_orderdate", "o_orderkey")), "o_custkey", "_ord")
    return out.drop("_ord").withColumn("o_orderdate", F.to_date("o_orderdate"))


@register("first_name_per_id", oracle("""
select cast(c_nationkey as bigint) as c_nationkey,
  coalesce(arg_min(trim(c_name), c_custkey) filter (where trim(coalesce(c_name, '')) <> ''), '') as c_name
from customer where c_nationkey is not null group by c_nationkey"""))
def q_first_name(spark, sf):
    c = read_source(spark, sf, "customer")
    return model.id_name_dim(c, "c_nationkey", "c_name", "c_custkey")
