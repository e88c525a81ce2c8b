"""Star schema: dimensions and facts built from processed event tables.

"First row wins" / "last row wins" in the source follow ingestion order. Every
input therefore carries an ordering column (``ord`` argument): for raw files
it is ``(processor_rank, file_path, position)``; for driver tables a natural
key such as ``event_index``. Picks of a few columns are ``min_by``/``max_by``
aggregates, picks of whole rows a row number under a partial group limit: either
way a key holding a third of the rows leaves each map task as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.coerce import bigint_col, blank_to_null, double_col, int_col, nested_to_null, norm_text
from touchline.functions.pitch import bucket, minute_absolute, time_key, zone_id

# Fact column lists (order matters for the exported layout).
FACT_CANDIDATE_COLUMNS = (
    "event_id", "match_id", "event_index", "period", "minute", "second", "timestamp", "team_id", "team_name",
    "player_id", "player_name", "type_id", "type_name", "play_pattern_id", "play_pattern_name", "position_id",
    "position_name", "pass_outcome_id", "pass_outcome_name", "shot_outcome_id", "shot_outcome_name",
    "shot_type_id", "shot_type_name", "body_part_id", "body_part_name", "shot_body_part_id",
    "shot_body_part_name", "duel_type_id", "duel_type_name", "duel_outcome_id", "duel_outcome_name",
    "location_x", "location_y", "pass_end_location_x", "pass_end_location_y", "carry_end_location_x",
    "carry_end_location_y", "shot_end_location_x", "shot_end_location_y", "shot_statsbomb_xg",
    "under_pressure", "counterpress",
)
FACT_EVENT_MINIMUM_COLUMNS = (
    "event_id", "match_id", "team_id", "player_id", "type_id", "period", "minute", "second", "location_x",
    "location_y", "play_pattern_id", "position_id", "under_pressure", "counterpress",
)
FACT_SHOT_BASE_COLUMNS = (
    "event_id", "match_id", "team_id", "player_id", "minute", "second", "period", "location_x", "location_y",
    "shot_end_location_x", "shot_end_location_y", "shot_statsbomb_xg", "shot_outcome_id", "shot_type_id",
    "body_part_id", "under_pressure",
)
KNOWN_SHOT_TYPE_IDS = (16,)
# Fixed values: (dimension, id column, name column(s)) for the nine event-derived small dims.
SMALL_DIMS = (
    ("dim_event_type", "type_id", "type_name", ("type_id",), ("type_name",)),
    ("dim_play_pattern", "play_pattern_id", "play_pattern_name", ("play_pattern_id",), ("play_pattern_name",)),
    ("dim_position", "position_id", "position_name", ("position_id",), ("position_name",)),
    ("dim_pass_outcome", "pass_outcome_id", "pass_outcome_name", ("pass_outcome_id",), ("pass_outcome_name",)),
    ("dim_shot_outcome", "shot_outcome_id", "shot_outcome_name", ("shot_outcome_id",),
     ("shot_outcome_name", "shot_outcome")),
    ("dim_shot_type", "shot_type_id", "shot_type_name", ("shot_type_id",), ("shot_type_name", "shot_type")),
    ("dim_body_part", "body_part_id", "body_part_name", ("body_part_id", "shot_body_part_id"),
     ("body_part_name", "shot_body_part_name")),
    ("dim_duel_type", "duel_type_id", "duel_type_name", ("duel_type_id",), ("duel_type_name",)),
    ("dim_duel_outcome", "duel_outcome_id", "duel_outcome_name", ("duel_outcome_id",), ("duel_outcome_name",)),
)
# Zone grid labels (x bands left to right, y bands top to bottom).
ZONE_X_LABELS = ("Defensive Sixth", "Build-Up Sixth", "Middle Sixth", "Attacking Sixth", "Final Third", "Box Sixth")
ZONE_Y_LABELS = ("Left Wing", "Left Half-Space", "Central", "Right Half-Space", "Right Wing")

_ID_SUFFIX = "_id"
_DOUBLE_COLS = {"location_x", "location_y", "pass_end_location_x", "pass_end_location_y", "carry_end_location_x",
                "carry_end_location_y", "shot_end_location_x", "shot_end_location_y", "shot_statsbomb_xg"}
_INT_COLS = {"period", "minute", "second"}


def _typed(df: DataFrame, name: str) -> Column:
    """Fact column typed as the model stores it (ids BIGINT, clock INT, coords DOUBLE)."""
    if name not in df.columns:
        if name.endswith(_ID_SUFFIX) or name == "event_index":
            return F.lit(None).cast("bigint") if name != "event_id" else F.lit(None).cast("string")
        if name in _DOUBLE_COLS:
            return F.lit(None).cast("double")
        if name in _INT_COLS:
            return F.lit(None).cast("int")
        return F.lit(None).cast("string")
    if name == "event_id":
        return blank_to_null(F.col(name))
    if name.endswith(_ID_SUFFIX) or name == "event_index":
        return bigint_col(df, name)
    if name in _DOUBLE_COLS:
        return double_col(df, name)
    if name in _INT_COLS:
        return int_col(df, name)
    dt = df.schema[name].dataType
    if isinstance(dt, T.StringType):
        return nested_to_null(F.col(name))
    return F.col(name)


# ---------------------------------------------------------------------------
# deduplication
# ---------------------------------------------------------------------------

def dedupe_first(df: DataFrame, keys: Sequence[str], ord: str | Column) -> DataFrame:
    """Keep the first row (by ``ord``) per key; rows with a null or blank
    key part are never dropped.

    One shuffle on the keys; before it every task keeps only its own first row per key
    (a partial group limit), so a hot key leaves each task as one row.
    """
    ordc = F.col(ord) if isinstance(ord, str) else ord
    complete = F.lit(True)
    for k in keys:
        c = F.col(k)
        complete = complete & c.isNotNull() & (F.trim(c.cast("string")) != "")
    # a row with an incomplete key gets a group of its own through its (unique) ingestion order, so it is never merged
    solo = F.when(~complete, F.to_json(F.struct(ordc.alias("o"))))
    first = Window.partitionBy(*[F.col(k) for k in keys], solo).orderBy(ordc)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def duplicate_extra_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q6: number of surplus rows, ``sum(n - 1)`` over keys seen more than once."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
              .agg(F.count(F.lit(1)).alias("duplicate_keys"),
                   F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")))


# ---------------------------------------------------------------------------
# Dimensions from events
# ---------------------------------------------------------------------------

def id_name_dim(df: DataFrame, id_col: str, name_col: str, ord: str | Column,
                out_id: str | None = None, out_name: str | None = None) -> DataFrame:
    """First non-empty (trimmed) name per id over all rows, else ''."""
    ordc = F.col(ord) if isinstance(ord, str) else ord
    name = F.trim(F.coalesce(F.col(name_col).cast("string"), F.lit("")))
    out = (df.select(bigint_col(df, id_col).alias("_id"), name.alias("_name"), ordc.alias("_ord"))
             .where(F.col("_id").isNotNull())
             .groupBy("_id")
             .agg(F.min_by("_name", F.when(F.col("_name") != "", F.col("_ord"))).alias("_name")))
    return out.select(F.col("_id").alias(out_id or id_col),
                      F.coalesce(F.col("_name"), F.lit("")).alias(out_name or name_col))


def small_dims_stacked(events: DataFrame, ord: str | Column) -> DataFrame:
    """A13 x 9 in one scan: (dim, id, name) for every event-derived small dim.

    Each event contributes up to nine (dim, id, name) entries via one
    ``inline`` of an array; one partial aggregation resolves all dims.
    """
    ordc = F.col(ord) if isinstance(ord, str) else ord
    entries = []
    for dim, _, _, id_cands, name_cands in SMALL_DIMS:
        ids = [bigint_col(events, c) for c in id_cands if c in events.columns]
        # '' counts as missing when falling back across candidate columns
        names = [blank_to_null(F.col(c)) for c in name_cands if c in events.columns]
        if not ids:
            continue
        id_expr = ids[0] if len(ids) == 1 else F.coalesce(*ids)
        if len(id_cands) > 1 and id_cands[0] in events.columns:
            first_raw = blank_to_null(F.col(id_cands[0]))
            id_expr = F.when(first_raw.isNotNull(), ids[0]).otherwise(F.coalesce(*ids[1:]) if len(ids) > 1 else None)
        name_expr = F.coalesce(*names, F.lit("")) if names else F.lit("")
        entries.append(F.struct(F.lit(dim).alias("dim"), id_expr.alias("id"), name_expr.alias("name")))
    if not entries:
        return events.sparkSession.createDataFrame([], "dim string, id bigint, name string")
    stacked = (events.select(ordc.alias("_ord"), F.explode(F.array(*entries)).alias("e"))
                     .select("_ord", "e.dim", "e.id", "e.name")
                     .where(F.col("id").isNotNull()))
    return (stacked.groupBy("dim", "id")
                   .agg(F.min_by("name", F.when(F.col("name") != "", F.col("_ord"))).alias("name"))
                   .select("dim", "id", F.coalesce("name", F.lit("")).alias("name")))


def small_dim(stacked: DataFrame, dim: str) -> DataFrame:
    """One named small dim out of :func:`small_dims_stacked`."""
    spec = {d: (i, n) for d, i, n, _, _ in SMALL_DIMS}[dim]
    return stacked.where(F.col("dim") == dim).select(F.col("id").alias(spec[0]), F.col("name").alias(spec[1]))


def dim_time(events: DataFrame) -> DataFrame:
    """Distinct (period, minute, second) with keys, buckets and half flags."""
    p, m, s = int_col(events, "period"), int_col(events, "minute"), int_col(events, "second")
    t = (events.select(p.alias("period"), m.alias("minute"), s.alias("second"))
               .where(F.col("period").isNotNull() & F.col("minute").isNotNull() & F.col("second").isNotNull())
               .distinct())
    ma = minute_absolute(F.col("period"), F.col("minute"))
    return t.select(
        time_key(F.col("period"), F.col("minute"), F.col("second")).alias("time_key"),
        "period", "minute", "second", ma.alias("minute_absolute"),
        bucket(ma, 5).alias("time_bucket_5min"), bucket(ma, 15).alias("time_bucket_15min"),
        (F.col("period") == 1).cast("int").alias("is_first_half"),
        (F.col("period") == 2).cast("int").alias("is_second_half"),
        (F.col("period") >= 3).cast("int").alias("is_extra_time"),
    )


def dim_zone(spark: SparkSession) -> DataFrame:
    """The 30 static pitch cells with bounds and labels."""
    cells = spark.range(30).select(F.col("id").alias("zone_id"))
    zx = (F.col("zone_id") % 6).cast("int")
    zy = (F.col("zone_id") / 6).cast("int")
    xl = F.array(*[F.lit(v) for v in ZONE_X_LABELS])
    yl = F.array(*[F.lit(v) for v in ZONE_Y_LABELS])
    return cells.select(
        F.col("zone_id").cast("bigint").alias("zone_id"), zx.alias("zone_x_index"), zy.alias("zone_y_index"),
        (zx * 20).alias("x_min"), (zx * 20 + 20).alias("x_max"), (zy * 16).alias("y_min"), (zy * 16 + 16).alias("y_max"),
        F.format_string("Zone %d (%s %s)", F.col("zone_id"), F.get(yl, zy), F.get(xl, zx)).alias("zone_label"),
    )


# ---------------------------------------------------------------------------
# facts
# ---------------------------------------------------------------------------

def shot_type_ids(events: DataFrame) -> DataFrame:
    """type ids that denote a shot: 16 plus every id seen with type name 'shot'."""
    spark = events.sparkSession
    known = spark.createDataFrame([(i,) for i in KNOWN_SHOT_TYPE_IDS], "shot_type_key bigint")
    if "type_name" not in events.columns or "type_id" not in events.columns:
        return known
    seen = (events.where(norm_text(F.col("type_name")) == "shot")
                  .select(bigint_col(events, "type_id").alias("shot_type_key"))
                  .where(F.col("shot_type_key").isNotNull()))
    return known.union(seen).distinct()


def flag_shots(events: DataFrame) -> DataFrame:
    """Adds ``is_shot`` (F7): by name, or by a join to the distinct shot type ids,
    a few rows whose size Spark knows before it joins."""
    tid = bigint_col(events, "type_id") if "type_id" in events.columns else F.lit(None).cast("bigint")
    name_is_shot = (F.coalesce(norm_text(F.col("type_name")) == "shot", F.lit(False))
                    if "type_name" in events.columns else F.lit(False))
    ids = shot_type_ids(events)
    j = events.join(ids, tid == ids["shot_type_key"], "left")
    return j.withColumn("is_shot", name_is_shot | F.col("shot_type_key").isNotNull()).drop("shot_type_key")


def with_match_meta(events: DataFrame, dim_match: DataFrame) -> DataFrame:
    """competition_id, season_id from the match dimension (left join)."""
    meta = dim_match.select(bigint_col(dim_match, "match_id").alias("_mm"),
                            (bigint_col(dim_match, "competition_id") if "competition_id" in dim_match.columns
                             else F.lit(None).cast("bigint")).alias("competition_id"),
                            (bigint_col(dim_match, "season_id") if "season_id" in dim_match.columns
                             else F.lit(None).cast("bigint")).alias("season_id"))
    ev = events.drop("competition_id", "season_id")
    return ev.join(meta, bigint_col(ev, "match_id") == meta["_mm"], "left").drop("_mm")


def fact_event_columns(events: DataFrame) -> list[str]:
    cols = [c for c in FACT_EVENT_MINIMUM_COLUMNS if c in events.columns]
    cols += [c for c in FACT_CANDIDATE_COLUMNS if c in events.columns and c not in cols]
    return cols


def fact_events(events: DataFrame, dim_match: DataFrame, ord: str | Column) -> DataFrame:
    """A26 (events branch): typed fact columns, zone, time key, competition and
    season; first row per (match_id, event_id)."""
    cols = fact_event_columns(events)
    has_loc = "location_x" in events.columns and "location_y" in events.columns
    ordc = F.col(ord) if isinstance(ord, str) else ord
    sel = [_typed(events, c).alias(c) for c in cols]
    if has_loc:
        sel.append(zone_id(double_col(events, "location_x"), double_col(events, "location_y")).alias("zone_id"))
    sel.append(time_key(_typed(events, "period"), _typed(events, "minute"), _typed(events, "second"))
               .alias("time_key"))
    typed = events.select(*sel, ordc.alias("_ord"))
    typed = dedupe_first(typed, ["match_id", "event_id"], "_ord")
    return with_match_meta(typed, dim_match).drop("_ord")


def fact_shots(events: DataFrame, ord: str | Column) -> DataFrame:
    """A26 (shots branch): shot rows, fixed column list, body part from
    ``body_part_id`` else ``shot_body_part_id``; first row per key."""
    ordc = F.col(ord) if isinstance(ord, str) else ord
    flagged = flag_shots(events)
    has_loc = "location_x" in events.columns and "location_y" in events.columns
    sel = []
    for c in FACT_SHOT_BASE_COLUMNS:
        if c == "body_part_id":
            cands = [x for x in ("body_part_id", "shot_body_part_id") if x in events.columns]
            if cands:
                raw = [blank_to_null(F.col(x)) for x in cands]
                first = F.coalesce(*raw) if len(raw) > 1 else raw[0]
                sel.append(first.try_cast("double").try_cast("bigint").alias(c))
            else:
                sel.append(F.lit(None).cast("bigint").alias(c))
        else:
            sel.append(_typed(events, c).alias(c))
    if has_loc:
        sel.append(zone_id(double_col(events, "location_x"), double_col(events, "location_y")).alias("zone_id"))
    sel.append(time_key(_typed(events, "period"), _typed(events, "minute"), _typed(events, "second"))
               .alias("time_key"))
    shots = flagged.where(F.col("is_shot")).select(*sel, ordc.alias("_ord"))
    return dedupe_first(shots, ["match_id", "event_id"], "_ord").drop("_ord")


# ---------------------------------------------------------------------------
# Entity dimensions
# ---------------------------------------------------------------------------

def first_row_per_key(df: DataFrame, key: str, ord: str | Column) -> DataFrame:
    """First row per key (competition, season)."""
    ordc = F.col(ord) if isinstance(ord, str) else ord
    cols = [c for c in df.columns if c != key]
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), ordc).alias("_r"))
              .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))


def last_row_per_key(df: DataFrame, key: str, ord: str | Column) -> DataFrame:
    """Last row per key (matches)."""
    ordc = F.col(ord) if isinstance(ord, str) else ord
    cols = [c for c in df.columns if c != key]
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), ordc).alias("_r"))
              .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))


def match_label(home_name: Column, away_name: Column, match_date: Column | None = None) -> Column:
    """P12: 'home vs away (date)'; '' when both names are blank."""
    h = F.trim(F.coalesce(home_name.cast("string"), F.lit("")))
    a = F.trim(F.coalesce(away_name.cast("string"), F.lit("")))
    if match_date is None:
        text = F.concat(h, F.lit(" vs "), a)
    else:
        d = F.trim(F.coalesce(match_date.cast("string"), F.lit("")))
        text = F.concat(h, F.lit(" vs "), a, F.lit(" ("), d, F.lit(")"))
    return F.when((h != "") | (a != ""), text).otherwise(F.lit(""))


def three_sixty_match_ids(visible_area: DataFrame | None, three_sixty: DataFrame | None) -> DataFrame:
    """Match ids with 360 data: from visible_area, else from three_sixty
    when visible_area yields none (decided per dataset, like the source, when the query runs)."""
    frames = [f.select(bigint_col(f, "match_id").alias("match_id")).where(F.col("match_id").isNotNull())
              for f in (visible_area, three_sixty) if f is not None and "match_id" in f.columns]
    if not frames:
        return None
    if len(frames) == 1:
        return frames[0].distinct()
    va, ts = frames
    # the choice is part of the plan: a subquery that stops at its first row
    return va.unionByName(ts.where(~va.exists())).distinct()


def dim_match(matches: DataFrame, ord: str | Column, ids_360: DataFrame | None = None) -> DataFrame:
    """A15 + P12 + J13: last row per match id, label and 360 availability."""
    def txt(c):
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in matches.columns else F.lit("")

    def num(c):
        return bigint_col(matches, c) if c in matches.columns else F.lit(None).cast("bigint")

    home_name = F.coalesce(blank_to_null(F.col("home_team_name")) if "home_team_name" in matches.columns else F.lit(None),
                           txt("home_team"), F.lit(""))
    away_name = F.coalesce(blank_to_null(F.col("away_team_name")) if "away_team_name" in matches.columns else F.lit(None),
                           txt("away_team"), F.lit(""))
    ordc = F.col(ord) if isinstance(ord, str) else ord
    rows = matches.select(
        num("match_id").alias("match_id"), num("competition_id").alias("competition_id"),
        num("season_id").alias("season_id"), txt("match_date").alias("match_date"), txt("kick_off").alias("kick_off"),
        num("home_team_id").alias("home_team_id"), num("away_team_id").alias("away_team_id"),
        F.trim(home_name).alias("home_team_name"), F.trim(away_name).alias("away_team_name"),
        num("home_score").alias("home_score"), num("away_score").alias("away_score"),
        txt("stadium_name").alias("stadium_name"), txt("referee_name").alias("referee_name"),
        num("match_week").alias("match_week"), txt("match_status").alias("match_status"),
        txt("last_updated").alias("last_updated"), txt("last_updated_360").alias("last_updated_360"),
        txt("match_status_360").alias("match_status_360"), ordc.alias("_ord"))
    last = last_row_per_key(rows, "match_id", "_ord").drop("_ord")
    last = last.withColumn("match_label", match_label(F.col("home_team_name"), F.col("away_team_name"),
                                                      F.col("match_date")))
    flag = (F.col("match_status_360") != "") | (F.col("last_updated_360") != "")
    if ids_360 is not None:
        ids = ids_360.select(F.col("match_id").alias("_m360")).distinct()
        last = last.join(ids, last["match_id"] == ids["_m360"], "left")
        flag = flag | F.col("_m360").isNotNull()
    out = last.withColumn("is_360_available", flag.cast("int"))
    return out.drop("_m360") if ids_360 is not None else out


def dim_team(teams: DataFrame | None, matches: DataFrame | None, lineups: DataFrame | None) -> DataFrame:
    """Team names with source precedence.

    teams (last row wins) < matches (last match by first appearance, away after
    home; overrides even with an empty name) < lineups (first non-empty name,
    used only when the name so far is missing or empty).
    """
    parts = []
    if teams is not None:
        t = (teams.select(bigint_col(teams, "team_id").alias("team_id"),
                          F.trim(F.coalesce(F.col("team_name").cast("string"), F.lit(""))).alias("name"),
                          F.col("_ord").alias("o"))
             .where(F.col("team_id").isNotNull()).groupBy("team_id")
             .agg(F.max_by("name", "o").alias("teams_name")))
        parts.append(t)
    if matches is not None:
        per_match = matches.select(
            bigint_col(matches, "match_id").alias("match_id"), F.col("_ord").alias("o"),
            bigint_col(matches, "home_team_id").alias("h"), bigint_col(matches, "away_team_id").alias("a"),
            F.trim(F.coalesce(blank_to_null(F.col("home_team_name")) if "home_team_name" in matches.columns else F.lit(None),
                              F.col("home_team").cast("string") if "home_team" in matches.columns else F.lit(None),
                              F.lit(""))).alias("hn"),
            F.trim(F.coalesce(blank_to_null(F.col("away_team_name")) if "away_team_name" in matches.columns else F.lit(None),
                              F.col("away_team").cast("string") if "away_team" in matches.columns else F.lit(None),
                              F.lit(""))).alias("an"),
        ).where(F.col("match_id").isNotNull())
        # dict semantics: position = first appearance of the match id, values = its last row
        m = per_match.groupBy("match_id").agg(F.min("o").alias("first_o"),
                                              F.max_by(F.struct("h", "a", "hn", "an"), "o").alias("r"))
        sides = m.select(F.explode(F.array(
            F.struct(F.col("r.h").alias("team_id"), F.col("r.hn").alias("name"),
                     F.struct(F.col("first_o").alias("o"), F.lit(0).alias("side")).alias("k")),
            F.struct(F.col("r.a").alias("team_id"), F.col("r.an").alias("name"),
                     F.struct(F.col("first_o").alias("o"), F.lit(1).alias("side")).alias("k")))).alias("s"))
        mt = (sides.select("s.*").where(F.col("team_id").isNotNull()).groupBy("team_id")
                   .agg(F.max_by("name", "k").alias("matches_name")))
        parts.append(mt)
    if lineups is not None:
        nm = F.trim(F.coalesce(F.col("team_name").cast("string"), F.lit("")))
        lt = (lineups.select(bigint_col(lineups, "team_id").alias("team_id"), nm.alias("name"), F.col("_ord").alias("o"))
              .where(F.col("team_id").isNotNull()).groupBy("team_id")
              .agg(F.min_by("name", F.when(F.col("name") != "", F.col("o"))).alias("lineup_name")))
        parts.append(lt)
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "team_id", "full")
    base = F.coalesce(*[F.col(c) for c in ("matches_name", "teams_name") if c in out.columns], F.lit(None).cast("string"))
    if "lineup_name" in out.columns:
        name = F.when(F.coalesce(base, F.lit("")) == "", F.coalesce(F.col("lineup_name"), base, F.lit(""))).otherwise(base)
    else:
        name = F.coalesce(base, F.lit(""))
    return out.select("team_id", name.alias("team_name"))


def dim_player(players: DataFrame | None, lineups: DataFrame | None) -> DataFrame:
    """Players (last row wins), then lineups fill an empty name and a
    missing team separately, each with its first usable value in order."""
    parts = []
    if players is not None:
        p = (players.select(bigint_col(players, "player_id").alias("player_id"),
                            F.trim(F.coalesce(F.col("player_name").cast("string"), F.lit(""))).alias("n"),
                            (bigint_col(players, "team_id") if "team_id" in players.columns
                             else F.lit(None).cast("bigint")).alias("t"), F.col("_ord").alias("o"))
             .where(F.col("player_id").isNotNull()).groupBy("player_id")
             .agg(F.max_by(F.struct("n", "t"), "o").alias("r"))
             .select("player_id", F.col("r.n").alias("base_name"), F.col("r.t").alias("base_team")))
        parts.append(p)
    if lineups is not None:
        n = F.trim(F.coalesce(F.col("player_name").cast("string"), F.lit("")))
        lu = (lineups.select(bigint_col(lineups, "player_id").alias("player_id"), n.alias("n"),
                             bigint_col(lineups, "team_id").alias("t"), F.col("_ord").alias("o"))
              .where(F.col("player_id").isNotNull()).groupBy("player_id")
              .agg(F.min_by("n", F.when(F.col("n") != "", F.col("o"))).alias("lineup_name"),
                   F.min_by("t", F.when(F.col("t").isNotNull(), F.col("o"))).alias("lineup_team")))
        parts.append(lu)
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "player_id", "full")
    base_name = F.col("base_name") if "base_name" in out.columns else F.lit(None).cast("string")
    base_team = F.col("base_team") if "base_team" in out.columns else F.lit(None).cast("bigint")
    l_name = F.col("lineup_name") if "lineup_name" in out.columns else F.lit(None).cast("string")
    l_team = F.col("lineup_team") if "lineup_team" in out.columns else F.lit(None).cast("bigint")
    name = F.when(F.coalesce(base_name, F.lit("")) != "", base_name).otherwise(F.coalesce(l_name, F.lit("")))
    return out.select("player_id", name.alias("player_name"), F.coalesce(base_team, l_team).alias("team_id"))


# ---------------------------------------------------------------------------
# Lineup and 360 facts
# ---------------------------------------------------------------------------

# Columns of the lineup fact.
FACT_LINEUP_COLUMNS = ("match_id", "team_id", "player_id", "position_id", "jersey_number", "starter", "from", "to")


def fact_lineups_players(lineups: DataFrame) -> DataFrame:
    """The eight lineup columns; JSON-looking text blanked."""
    sel = []
    for c in FACT_LINEUP_COLUMNS:
        if c not in lineups.columns:
            sel.append(F.lit(None).cast("string").alias(c))
        elif c.endswith("_id"):
            sel.append(bigint_col(lineups, c).alias(c))
        elif isinstance(lineups.schema[c].dataType, T.StringType):
            sel.append(nested_to_null(F.col(c)).alias(c))
        else:
            sel.append(F.col(c).alias(c))
    return lineups.select(*sel)


def fact_three_sixty(visible_area: DataFrame | None, three_sixty: DataFrame | None) -> DataFrame:
    """(match, event_uuid, point count, has_visible_area = count > 0);
    source is visible_area, else three_sixty."""
    src = visible_area if visible_area is not None else three_sixty
    cnt = (bigint_col(src, "visible_area_point_count") if "visible_area_point_count" in src.columns
           else F.lit(None).cast("bigint"))
    return src.select(bigint_col(src, "match_id").alias("match_id"), F.col("event_uuid").cast("string"),
                      cnt.alias("visible_area_point_count"),
                      F.coalesce(cnt > 0, F.lit(False)).cast("int").alias("has_visible_area"))


def fact_three_sixty_freeze_frames(freeze_frames: DataFrame) -> DataFrame:
    """Freeze-frame rows with typed coordinates and zone id."""
    x, y = double_col(freeze_frames, "location_x"), double_col(freeze_frames, "location_y")
    return freeze_frames.select(
        bigint_col(freeze_frames, "match_id").alias("match_id"), F.col("event_uuid").cast("string"),
        bigint_col(freeze_frames, "player_id").alias("player_id"),
        *[F.col(c).alias(c) if c in freeze_frames.columns else F.lit(None).cast("boolean").alias(c)
          for c in ("teammate", "actor", "keeper")],
        x.alias("location_x"), y.alias("location_y"), zone_id(x, y).alias("zone_id"))


# ---------------------------------------------------------------------------
# K6: model notes (grain and relationships)
# ---------------------------------------------------------------------------

# Table grains and fact -> dimension relationships of the model.
MODEL_GRAINS = (
    ("dim_competition", "competition_id"), ("dim_season", "season_id"), ("dim_match", "match_id"),
    ("dim_team", "team_id"), ("dim_player", "player_id"), ("dim_zone", "zone_id"),
    ("dim_time", "period, minute, second"), ("fact_events", "match_id, event_id"),
    ("fact_shots", "match_id, event_id"), ("fact_lineups_players", "match_id, team_id, player_id"),
    ("fact_three_sixty", "event_uuid"), ("fact_three_sixty_freeze_frames", "match_id, event_uuid, player_id"),
)
MODEL_RELATIONSHIPS = (
    ("fact_events", "match_id", "dim_match"), ("fact_events", "team_id", "dim_team"),
    ("fact_events", "player_id", "dim_player"), ("fact_events", "zone_id", "dim_zone"),
    ("fact_events", "time_key", "dim_time"), ("fact_shots", "match_id", "dim_match"),
    ("fact_shots", "team_id", "dim_team"), ("fact_shots", "player_id", "dim_player"),
    ("fact_shots", "shot_outcome_id", "dim_shot_outcome"), ("fact_shots", "body_part_id", "dim_body_part"),
    ("fact_shots", "shot_type_id", "dim_shot_type"), ("dim_match", "competition_id", "dim_competition"),
    ("dim_match", "season_id", "dim_season"), ("fact_lineups_players", "match_id", "dim_match"),
    ("fact_lineups_players", "team_id", "dim_team"), ("fact_lineups_players", "player_id", "dim_player"),
    ("fact_three_sixty", "match_id", "dim_match"), ("fact_three_sixty_freeze_frames", "player_id", "dim_player"),
    ("fact_shots", "zone_id", "dim_zone"), ("fact_shots", "time_key", "dim_time"),
)


def model_notes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """K6: (grains, relationships) as small static tables."""
    return (spark.createDataFrame(list(MODEL_GRAINS), "table string, grain string"),
            spark.createDataFrame(list(MODEL_RELATIONSHIPS), "fact string, key string, dimension string"))
