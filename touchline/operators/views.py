"""Model views used by the reports: filtered fact scans, shot labels, names
from dimensions, match/team/player lists (all matches at once).

Dimension joins are plain left equi-joins on BIGINT ids; AQE turns them into
broadcast joins from measured runtime sizes and keeps shuffle joins when a
dimension is larger than the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.coerce import bigint_col, coalesce_existing, existing, label_or_null, norm_text
from touchline.sources.tables import read_order

# Canonical goal outcome id.
GOAL_OUTCOME_ID = 97
# Columns of the lineup slice of fact_events.
LINEUP_EVENT_COLUMNS = ("event_id", "event_index", "match_id", "team_id", "team_name", "player_id", "player_name",
                        "position_id", "position_name", "minute", "second", "period", "type_name",
                        "tactics_formation", "formation", "team_formation", "starting_formation",
                        "tactics_lineup", "lineup")


def fact_scan(df: DataFrame, match_id: int | None = None, team_id: int | None = None, player_id: int | None = None,
              columns: Sequence[str] | None = None) -> DataFrame:
    """S6 + S8 + F8: tolerant projected scan with optional id predicates.

    Ids are compared as plain BIGINT columns so the predicates reach the
    Parquet scan (PushedFilters). Missing ``match_id`` gives an empty result;
    a missing team/player column skips that predicate.
    """
    out = df
    if match_id is not None:
        if "match_id" not in df.columns:
            return df.where(F.lit(False))
        out = out.where(bigint_col(df, "match_id") == int(match_id))
    if team_id is not None and "team_id" in df.columns:
        out = out.where(bigint_col(df, "team_id") == int(team_id))
    if player_id is not None and "player_id" in df.columns:
        out = out.where(bigint_col(df, "player_id") == int(player_id))
    if columns is not None:
        out = out.select(*existing(df, columns))
    return out


def lineup_events(fact_events: DataFrame, match_id: int | None = None) -> DataFrame:
    """The lineup slice of fact_events (columns that exist)."""
    return fact_scan(fact_events, match_id=match_id, columns=LINEUP_EVENT_COLUMNS)


def dedupe_shots(shots: DataFrame) -> DataFrame:
    """One row per (match_id, event_id) -- or per event_id when there is no
    match column -- keeping the first by (period, minute, second), nulls last.

    Null keys form one group (the source's drop_duplicates semantics). Rows equal in the clock go
    by event index, then by a hash of the row. Each task keeps its own first row per key before
    the one shuffle, so a duplicated key never reaches a task whole.
    """
    if "event_id" not in shots.columns:
        return shots
    keys = ["match_id", "event_id"] if "match_id" in shots.columns else ["event_id"]
    parts = [bigint_col(shots, c).asc_nulls_last() for c in ("period", "minute", "second", "event_index") if c in shots.columns]
    first = Window.partitionBy(*keys).orderBy(*parts, F.xxhash64(*[F.col(f"`{c}`") for c in shots.columns]))
    return shots.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def lookup_names(dim: DataFrame | None, id_col: str, name_col: str, unique: bool = False, order: Column | None = None) -> DataFrame | None:
    """D3: (id, name) lookup with a numeric key, the first row of each id, its name null or not.

    First is by ``order``; without one by file and row index where ``dim`` is read from
    Parquet; rows without any order are taken by name. A dimension already unique on its
    key (model dims, checked by Q9) skips the aggregation.
    """
    if dim is None or id_col not in dim.columns or name_col not in dim.columns:
        return None
    order = order if order is not None else read_order(dim)
    name = F.col(name_col).cast("string")
    lk = (dim.select(bigint_col(dim, id_col).alias(id_col), name.alias(name_col), (name if order is None else order).alias("_o"))
             .where(F.col(id_col).isNotNull()))
    return lk.drop("_o") if unique else lk.groupBy(id_col).agg(F.min_by(name_col, "_o").alias(name_col))


def _legacy(df: DataFrame, names: Sequence[str]) -> Column | None:
    cols = [label_or_null(F.col(c)) for c in names if c in df.columns]
    if not cols:
        return None
    return cols[0] if len(cols) == 1 else F.coalesce(*cols)


def ensure_shot_labels(shots: DataFrame, dim_shot_outcome: DataFrame | None, dim_body_part: DataFrame | None,
                       dim_shot_type: DataFrame | None, dims_unique: bool = False) -> DataFrame:
    """Readable shot_outcome, body_part, shot_type.

    A legacy text label wins when it is not numeric-looking; otherwise the
    dimension label of the id. ``*_name`` label columns are dropped.
    """
    out = shots
    if "body_part_id" not in out.columns and "shot_body_part_id" in out.columns:
        out = out.withColumn("body_part_id", F.col("shot_body_part_id"))
    for c in ("shot_outcome_id", "body_part_id", "shot_type_id"):
        if c in out.columns:
            out = out.withColumn(c, bigint_col(out, c))
    legacy = {
        "shot_outcome": _legacy(out, ["shot_outcome_name", "shot_outcome"]),
        "body_part": _legacy(out, ["body_part_name", "body_part", "shot_body_part_name"]),
        "shot_type": _legacy(out, ["shot_type_name", "shot_type"]),
    }
    specs = (("shot_outcome", "shot_outcome_id", dim_shot_outcome, "shot_outcome_name"),
             ("body_part", "body_part_id", dim_body_part, "body_part_name"),
             ("shot_type", "shot_type_id", dim_shot_type, "shot_type_name"))
    new_cols = {}
    for label, id_col, dim, dim_name in specs:
        lk = lookup_names(dim, id_col, dim_name, dims_unique)
        mapped = F.lit(None).cast("string")
        if lk is not None and id_col in out.columns:
            alias = f"_lbl_{label}"
            lk = lk.select(F.col(id_col).alias(f"_k_{label}"), F.col(dim_name).alias(alias))
            out = out.join(lk, out[id_col] == lk[f"_k_{label}"], "left").drop(f"_k_{label}")
            mapped = F.col(alias)
        new_cols[label] = F.coalesce(legacy[label], mapped) if legacy[label] is not None else mapped
    out = out.withColumns({k: v.cast("string") for k, v in new_cols.items()})
    return out.drop("_lbl_shot_outcome", "_lbl_body_part", "_lbl_shot_type", "shot_outcome_name",
                    "body_part_name", "shot_type_name")


def with_names_from_dims(view: DataFrame, dim_team: DataFrame | None, dim_player: DataFrame | None,
                         dims_unique: bool = False) -> DataFrame:
    """Fill null team/player names from the dimensions."""
    out = view
    for dim, id_col, name_col in ((dim_team, "team_id", "team_name"), (dim_player, "player_id", "player_name")):
        lk = lookup_names(dim, id_col, name_col, dims_unique)
        if lk is None or id_col not in out.columns:
            if name_col not in out.columns:
                out = out.withColumn(name_col, F.lit(None).cast("string"))
            continue
        lk = lk.select(F.col(id_col).alias("_k"), F.col(name_col).alias("_n"))
        out = out.join(lk, bigint_col(out, id_col) == lk["_k"], "left")
        name = F.coalesce(F.col(name_col), F.col("_n")) if name_col in view.columns else F.col("_n")
        out = out.withColumn(name_col, name).drop("_k", "_n")
    return out


def shots_view(fact_shots: DataFrame, dim_team: DataFrame | None = None,
               dim_player: DataFrame | None = None, dims_unique: bool = False) -> DataFrame:
    """Canonical x, y, xg, labels and ``is_goal`` (label goal or outcome id 97)."""
    v = fact_shots.withColumns({
        "x": coalesce_existing(fact_shots, ["x", "location_x"]).try_cast("double"),
        "y": coalesce_existing(fact_shots, ["y", "location_y"]).try_cast("double"),
        "xg": coalesce_existing(fact_shots, ["xg", "shot_statsbomb_xg"]).try_cast("double"),
        "shot_outcome": coalesce_existing(fact_shots, ["shot_outcome", "shot_outcome_name"]).cast("string"),
        "shot_type": coalesce_existing(fact_shots, ["shot_type", "shot_type_name"]).cast("string"),
        "body_part": coalesce_existing(fact_shots, ["body_part", "body_part_name", "shot_body_part_name",
                                                    "shot_body_part"]).cast("string"),
    })
    goal = F.coalesce(norm_text(F.col("shot_outcome")) == "goal", F.lit(False))
    if "shot_outcome_id" in fact_shots.columns:
        goal = goal | F.coalesce(bigint_col(fact_shots, "shot_outcome_id") == GOAL_OUTCOME_ID, F.lit(False))
    v = v.withColumn("is_goal", goal)
    return with_names_from_dims(v, dim_team, dim_player, dims_unique)


def events_view(fact_events: DataFrame, dim_team: DataFrame | None = None,
                dim_player: DataFrame | None = None, dims_unique: bool = False) -> DataFrame:
    """Events with x, y, xg and a shot outcome label, names from dims."""
    def first(cands):
        c = existing(fact_events, cands)
        return F.col(c[0]).try_cast("double") if c else F.lit(None).cast("double")

    v = fact_events.withColumns({
        "x": first(["x", "location_x"]), "y": first(["y", "location_y"]), "xg": first(["xg", "shot_statsbomb_xg"]),
        "shot_outcome": coalesce_existing(fact_events, ["shot_outcome", "shot_outcome_name", "outcome_name",
                                                        "outcome_id"]).cast("string"),
    })
    return with_names_from_dims(v, dim_team, dim_player, dims_unique)


def enrich_dim_match(dim_match: DataFrame, dim_team: DataFrame | None = None,
                     dim_competition: DataFrame | None = None, dim_season: DataFrame | None = None) -> DataFrame:
    """Competition, season, home and away team names (only if absent)."""
    out = dim_match
    for c in ("competition_id", "season_id", "home_team_id", "away_team_id"):
        if c in out.columns:
            out = out.withColumn(c, bigint_col(out, c))
    joins = [(dim_competition, "competition_id", "competition_name", "competition_id", "competition_name"),
             (dim_season, "season_id", "season_name", "season_id", "season_name"),
             (dim_team, "team_id", "team_name", "home_team_id", "home_team_name"),
             (dim_team, "team_id", "team_name", "away_team_id", "away_team_name")]
    for dim, id_col, name_col, target_id, target_name in joins:
        if target_name in out.columns or target_id not in out.columns:
            continue
        lk = lookup_names(dim, id_col, name_col)
        if lk is None:
            continue
        lk = lk.select(F.col(id_col).alias("_k"), F.col(name_col).alias(target_name))
        out = out.join(lk, out[target_id] == lk["_k"], "left").drop("_k")
    return out


def _label(dim_match: DataFrame) -> Column:
    """The given match label, else one made of the names and the date."""
    if "match_label" in dim_match.columns:
        return F.col("match_label")
    home, away = (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in dim_match.columns else F.lit("") for c in ("home_team_name", "away_team_name"))
    label = F.concat(home, F.lit(" vs "), away)
    if "match_date" in dim_match.columns:
        label = F.concat(label, F.lit(" ("), F.col("match_date").cast("string"), F.lit(")"))
    return label


def matches_list(dim_match: DataFrame, competition_id: int | None = None, season_id: int | None = None) -> DataFrame:
    """matches of a competition/season, newest first (date desc, id desc)."""
    out = dim_match
    if competition_id is not None and "competition_id" in out.columns:
        out = out.where(bigint_col(out, "competition_id") == int(competition_id))
    if season_id is not None and "season_id" in out.columns:
        out = out.where(bigint_col(out, "season_id") == int(season_id))
    out = out.withColumn("match_label", _label(out))
    order = [F.col(c).desc() for c in ("match_date", "match_id") if c in out.columns]
    return out.orderBy(*order) if order else out


def teams_for_matches(dim_match: DataFrame, fact_events: DataFrame | None, fact_shots: DataFrame | None,
                      dim_team: DataFrame | None) -> DataFrame:
    """(match_id, team_id, team_name) for every match.

    Home/away from dim_match; matches without a dim row (or without ids) fall
    back to the distinct teams of the facts. Names: given name, else the
    dimension name, else the id as text.
    """
    def side(s):
        name = F.col(f"{s}_team_name").cast("string") if f"{s}_team_name" in dim_match.columns else F.lit(None).cast("string")
        return dim_match.select(bigint_col(dim_match, "match_id").alias("match_id"),
                                bigint_col(dim_match, f"{s}_team_id").alias("team_id"), name.alias("team_name"))

    from_dim = side("home").unionByName(side("away"))
    dim_matches = from_dim.select("match_id").distinct()
    facts = []
    for f in (fact_events, fact_shots):
        if f is not None and "match_id" in f.columns and "team_id" in f.columns:
            nm = F.col("team_name").cast("string") if "team_name" in f.columns else F.lit(None).cast("string")
            facts.append(f.select(bigint_col(f, "match_id").alias("match_id"), bigint_col(f, "team_id").alias("team_id"),
                                  nm.alias("team_name")).distinct())
    rows = from_dim
    if facts:
        fb = facts[0] if len(facts) == 1 else facts[0].unionByName(facts[1])
        rows = rows.unionByName(fb.join(dim_matches, "match_id", "left_anti"))
    rows = rows.where(F.col("team_id").isNotNull() & F.col("match_id").isNotNull())
    rows = with_names_from_dims(rows, dim_team, None) if dim_team is not None else rows
    return (rows.groupBy("match_id", "team_id")
                .agg(F.min("team_name").alias("team_name"))
                .withColumn("team_name", F.coalesce(F.col("team_name"), F.col("team_id").cast("string"))))


def _player_rows(fact_events: DataFrame | None, fact_shots: DataFrame | None) -> DataFrame | None:
    """``match_id, player_id, team_id, player_name`` of the facts' rows that name a player."""
    frames = []
    for f in (fact_events, fact_shots):
        if f is None or "match_id" not in f.columns or "player_id" not in f.columns:
            continue
        team = bigint_col(f, "team_id") if "team_id" in f.columns else F.lit(None).cast("bigint")
        nm = F.col("player_name").cast("string") if "player_name" in f.columns else F.lit(None).cast("string")
        frames.append(f.select(bigint_col(f, "match_id").alias("match_id"), bigint_col(f, "player_id").alias("player_id"),
                               team.alias("team_id"), nm.alias("player_name")))
    rows = concat_frames(frames)
    return None if rows is None else rows.where(F.col("player_id").isNotNull())


def _with_player_dim(rows: DataFrame, dim_player: DataFrame | None) -> DataFrame:
    """Names and missing teams of ``rows`` from the first row of each player in the dimension."""
    if dim_player is None or "player_id" not in dim_player.columns:
        return rows
    order = read_order(dim_player)
    dp = dim_player.select(bigint_col(dim_player, "player_id").alias("_p"),
                           F.struct((order if order is not None else F.col("player_name").cast("string")).alias("o"),
                                    F.col("player_name").cast("string").alias("n"),
                                    (bigint_col(dim_player, "team_id") if "team_id" in dim_player.columns
                                     else F.lit(None).cast("bigint")).alias("t")).alias("_d"))
    dp = dp.groupBy("_p").agg(F.min("_d").alias("_d"))
    return (rows.join(dp, rows["player_id"] == dp["_p"], "left")
                .withColumn("player_name", F.coalesce("player_name", "_d.n"))
                .withColumn("team_id", F.coalesce("team_id", "_d.t")).drop("_p", "_d"))


def players_for_matches(fact_events: DataFrame | None, fact_shots: DataFrame | None, dim_player: DataFrame | None,
                        dim_team: DataFrame | None, team_id: int | None = None) -> DataFrame:
    """(match_id, player_id, player_name, team_id, team_name) over events
    and shots; names and missing teams from the dimensions."""
    rows = _player_rows(fact_events, fact_shots)
    if team_id is not None:  # a player may have played for several teams: choose the rows, then the player's team
        rows = rows.where(F.col("team_id") == int(team_id))
    per = rows.groupBy("match_id", "player_id").agg(F.min("team_id").alias("team_id"),
                                                     F.min("player_name").alias("player_name"))
    per = _with_player_dim(per, dim_player)
    lk = lookup_names(dim_team, "team_id", "team_name")
    if lk is not None:
        lk = lk.select(F.col("team_id").alias("_t"), F.col("team_name"))
        per = per.join(lk, per["team_id"] == lk["_t"], "left").drop("_t")
    else:
        per = per.withColumn("team_name", F.lit(None).cast("string"))
    return per.withColumn("player_name", F.coalesce(F.col("player_name"), F.col("player_id").cast("string")))


def team_filter(events: DataFrame, team_id: int | None = None, team_name: str | None = None) -> DataFrame:
    """rows of a team by id, else by case-insensitive (trimmed) name."""
    if team_id is not None and "team_id" in events.columns:
        return events.where(bigint_col(events, "team_id") == int(team_id))
    if team_name and "team_name" in events.columns:
        return events.where(F.lower(F.trim(F.col("team_name").cast("string"))) == team_name.strip().lower())
    return events


def top_rows(df: DataFrame, order: Sequence[Column], n: int = 200) -> DataFrame:
    """The first ``n`` rows under an explicit, total order (a report table)."""
    return df.orderBy(*order).limit(n)


def concat_frames(frames: Sequence[DataFrame | None]) -> DataFrame | None:
    """Union of the given frames by column name; missing columns become null."""
    valid = [f for f in frames if f is not None]
    if not valid:
        return None
    out = valid[0]
    for f in valid[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


#: The levels of the choices, each below the one before, with the bits that grouping_id() has for them.
LEVELS = (("competition", 15), ("season", 7), ("match", 3), ("team", 1), ("player", 0))


def cascade_levels(dim_match: DataFrame, fact_events: DataFrame | None = None, fact_shots: DataFrame | None = None,
                   dim_team: DataFrame | None = None, dim_player: DataFrame | None = None) -> DataFrame:
    """Every choice of the five levels with its parents, as rows ``level, competition_id,
    season_id, match_id, team_id, player_id, label`` (ids below the level are null).

    Matches, their teams (U1) and their players (U2, a player once for each team played for) are
    stacked under their match's competition and season, and one pass over grouping sets makes
    the levels: each row is combined map-side into its five groups. Choices without an id are
    left out; a label is that of the first match, else the id.
    """
    def text(c: str) -> Column:
        return F.col(c).cast("string") if c in dim_match.columns else F.lit(None).cast("string")

    def num(c: str) -> Column:
        return bigint_col(dim_match, c) if c in dim_match.columns else F.lit(None).cast("bigint")

    none = F.lit(None).cast("bigint")
    meta = dim_match.select(num("match_id").alias("match_id"), num("competition_id").alias("competition_id"), text("competition_name").alias("competition_name"),
                            num("season_id").alias("season_id"), text("season_name").alias("season_name"), _label(dim_match).alias("match_label"))
    teams = teams_for_matches(dim_match, fact_events, fact_shots, dim_team)
    stacked = (meta.select("match_id", none.alias("team_id"), none.alias("player_id"), F.lit(None).cast("string").alias("own"))
               .unionByName(teams.select("match_id", "team_id", none.alias("player_id"), F.col("team_name").alias("own"))))
    players = _player_rows(fact_events, fact_shots)
    if players is not None:
        players = players.groupBy("match_id", "team_id", "player_id").agg(F.min("player_name").alias("player_name"))
        players = _with_player_dim(players, dim_player)
        stacked = stacked.unionByName(players.select("match_id", "team_id", "player_id", F.coalesce("player_name", F.col("player_id").cast("string")).alias("own")))
    keys = ["competition_id", "season_id", "match_id", "team_id", "player_id"]
    rows = stacked.join(meta, "match_id", "left").withColumn("first", F.struct("match_id"))
    named_team = F.col("player_id").isNull() & F.col("team_id").isNotNull()
    grouped = rows.groupingSets([[F.col(k) for k in keys[:n]] for n in range(1, 6)], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_g"), F.min_by("competition_name", "first").alias("_competition"), F.min_by("season_name", "first").alias("_season"),
        F.min("match_label").alias("_match"), F.min(F.when(named_team, F.col("own"))).alias("_team"),
        F.min(F.when(F.col("player_id").isNotNull(), F.col("own"))).alias("_player"))
    level = id_there = label = F.lit(None)
    for (name, bits), key in zip(LEVELS, keys, strict=True):
        at = F.col("_g") == bits
        level = F.when(at, F.lit(name)).otherwise(level)
        # a team is a choice where U1 has it, not because a player was seen with it
        id_there = F.when(at, F.col("_team").isNotNull() if name == "team" else F.col(key).isNotNull()).otherwise(id_there)
        label = F.when(at, F.coalesce(F.col(f"_{name}"), F.col(key).cast("string"))).otherwise(label)
    return grouped.where(id_there).select(level.alias("level"), *keys, label.alias("label"))


def cascade_choices(dim_match: DataFrame, competition_id: int | None = None, season_id: int | None = None, match_id: int | None = None,
                    team_id: int | None = None, fact_events: DataFrame | None = None, fact_shots: DataFrame | None = None,
                    dim_team: DataFrame | None = None, dim_player: DataFrame | None = None) -> dict[str, DataFrame]:
    """U5 (data side): distinct choices per level, each sorted for display: competitions and
    seasons by name, matches of the chosen competition and season (newest first), teams of
    the chosen match, players of the chosen match and team."""
    def named(df: DataFrame, level: str) -> DataFrame:
        key, name = f"{level}_id", f"{level}_name"
        has = name in df.columns
        rows = df.select(bigint_col(df, key).alias(key), *[F.col(name)] * has).where(F.col(key).isNotNull())
        rows = rows.groupBy(key).agg(F.min(name).alias(name)) if has else rows.distinct()
        return rows.orderBy(name, key) if has else rows.orderBy(key)

    seasons = dim_match
    if competition_id is not None:
        seasons = seasons.where(bigint_col(dim_match, "competition_id") == int(competition_id))
    out = {"competitions": named(dim_match, "competition"), "seasons": named(seasons, "season"),
           "matches": matches_list(dim_match, competition_id, season_id)}
    teams = teams_for_matches(dim_match, fact_events, fact_shots, dim_team)
    out["teams"] = teams.where(F.col("match_id") == int(match_id)).orderBy("team_name", "team_id") if match_id is not None else teams
    if fact_events is not None or fact_shots is not None:
        frames = [f if f is None or match_id is None else fact_scan(f, match_id=match_id) for f in (fact_events, fact_shots)]
        out["players"] = players_for_matches(*frames, dim_player, dim_team, team_id).orderBy("player_name", "player_id")
    return out
