"""Starting XI, primary positions, formation and pitch placement (W3-W9,
P15-P18, J12), for every (match, team) at once.

Lineup documents come in as rows of ``lineups_raw`` (one per team entry with
its ``lineup`` array, as read by the JSON source) and are exploded with
positions; teams without a lineup entry fall back to the chronological
first-eleven rule over events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.coerce import bigint_col, norm_text
from touchline.functions.pitch import clock_seconds, formation_text, position_key

XI_SIZE = 11
# Attack-up pitch coordinates (x, y on 120 x 100) per normalised position name.
POSITION_COORDS = (
    ("goalkeeper", 60.0, 92.0),
    ("left back", 24.0, 82.0),
    ("left center back", 42.0, 84.0),
    ("center back", 60.0, 84.0),
    ("right center back", 78.0, 84.0),
    ("right back", 96.0, 82.0),
    ("left wing back", 18.0, 78.0),
    ("right wing back", 102.0, 78.0),
    ("left defensive midfield", 38.0, 73.0),
    ("center defensive midfield", 60.0, 72.0),
    ("right defensive midfield", 82.0, 73.0),
    ("left center midfield", 44.0, 67.0),
    ("center midfield", 60.0, 66.0),
    ("right center midfield", 76.0, 67.0),
    ("left midfield", 22.0, 64.0),
    ("right midfield", 98.0, 64.0),
    ("left wing", 20.0, 60.0),
    ("right wing", 100.0, 60.0),
    ("left attacking midfield", 38.0, 61.0),
    ("center attacking midfield", 60.0, 60.0),
    ("right attacking midfield", 82.0, 61.0),
    ("left center forward", 48.0, 56.0),
    ("center forward", 60.0, 55.0),
    ("right center forward", 72.0, 56.0),
    ("secondary striker", 60.0, 58.0),
)
UNMAPPED_XY = (60.0, 66.0)
FORMATION_COLUMNS = ("tactics_formation", "formation", "team_formation", "starting_formation")


def position_coords(spark: SparkSession) -> DataFrame:
    """The 25-row lookup (static, broadcast-sized by construction)."""
    return spark.createDataFrame(list(POSITION_COORDS), "pos_key string, x_up double, y_up double")


# ---------------------------------------------------------------------------
# Per-player position segments
# ---------------------------------------------------------------------------

def _segments(positions: Column) -> Column:
    """positions array -> array of (is_start, is_kickoff, secs, idx, seg) structs."""
    return F.transform(positions, lambda s, i: F.struct(
        F.coalesce(norm_text(s.getField("start_reason")) == "starting xi", F.lit(False)).alias("is_start"),
        F.coalesce(F.trim(s.getField("from").cast("string")) == "00:00", F.lit(False)).alias("is_kickoff"),
        clock_seconds(s.getField("from")).alias("secs"), i.alias("idx"), s.alias("seg")))


def primary_position(positions: Column) -> Column:
    """Starting XI segment at 00:00; else the earliest Starting XI one;
    else the earliest segment (ties by list order)."""
    segs = F.filter(_segments(positions), lambda s: s.getField("seg").isNotNull())
    ranked = F.transform(segs, lambda s: F.struct(
        F.when(s.getField("is_start") & s.getField("is_kickoff"), 0)
         .when(s.getField("is_start"), 1).otherwise(2).alias("rank"),
        F.when(s.getField("is_start") & s.getField("is_kickoff"), F.lit(0).cast("bigint"))
         .otherwise(s.getField("secs")).alias("secs"),
        s.getField("idx").alias("idx"), s.getField("seg").alias("seg")))
    return F.array_min(ranked).getField("seg")


def is_starter(positions: Column) -> Column:
    """Any segment started as 'Starting XI', else the earliest starts at 00:00."""
    segs = F.filter(_segments(positions), lambda s: s.getField("seg").isNotNull())
    any_start = F.exists(segs, lambda s: s.getField("is_start"))
    earliest = F.array_min(F.transform(segs, lambda s: F.struct(s.getField("secs").alias("secs"),
                                                               s.getField("idx").alias("idx"),
                                                               s.getField("is_kickoff").alias("k"))))
    return F.when(F.size(segs) == 0, F.lit(False)).when(any_start, F.lit(True)).otherwise(
        F.coalesce(earliest.getField("k"), F.lit(False)))


def lineup_players(lineups_raw: DataFrame) -> DataFrame:
    """One row per (match, team entry, player) with W5/W6 applied."""
    base = lineups_raw.select(
        bigint_col(lineups_raw, "match_id").alias("match_id"),
        bigint_col(lineups_raw, "team_id").alias("team_id"),
        F.col("team_name").cast("string").alias("team_name"),
        F.posexplode("lineup").alias("lineup_pos", "p"))
    seg = primary_position(F.col("p.positions"))
    return base.select(
        "match_id", "team_id", "team_name", "lineup_pos",
        F.col("p.player_id").cast("bigint").alias("player_id"),
        F.col("p.player_name").cast("string").alias("player_name"),
        F.col("p.jersey_number").cast("string").alias("jersey_number"),
        seg.getField("position_id").cast("bigint").alias("position_id"),
        seg.getField("position").cast("string").alias("position_name"),
        is_starter(F.col("p.positions")).alias("is_starter"))


def _entry_order(lineups_raw: DataFrame) -> Column:
    """Read order of the entries: the ingestion columns where they are, else the entry's own values."""
    there = [c for c in ("_rank", "_file", "_pos") if c in lineups_raw.columns]
    return F.struct(*[F.col(c) for c in there]) if there else F.struct("team_id", "team_name")


def _name_key(name: Column) -> Column:
    return norm_text(F.coalesce(name.cast("string"), F.lit("")))


def _entry_picks(lineups_raw: DataFrame) -> DataFrame:
    """Each team entry with ``picks``, its eleven at most: starters, else the first 11 players,
    numbered, then without repeated (player id, name). Within a row, nothing is shuffled."""
    e = lineups_raw.select(bigint_col(lineups_raw, "match_id").alias("match_id"), bigint_col(lineups_raw, "team_id").alias("team_id"),
                           "team_name", _entry_order(lineups_raw).alias("_ord"),
                           F.filter("lineup", lambda p: p.isNotNull()).alias("_all"))
    e = e.withColumn("_start", F.filter("_all", lambda p: is_starter(p["positions"])))
    e = e.withColumn("_chosen", F.when(F.size("_start") > 0, F.col("_start")).otherwise(F.slice("_all", 1, XI_SIZE)))

    def pick(p: Column, i: Column) -> Column:
        seg = primary_position(p["positions"])
        return F.struct(p["player_id"].cast("bigint").alias("player_id"), p["player_name"].cast("string").alias("player_name"),
                        p["jersey_number"].cast("string").alias("jersey_number"), seg["position_id"].cast("bigint").alias("position_id"),
                        seg["position"].cast("string").alias("position_name"), (i + 1).alias("sort_order"))

    e = e.withColumn("_num", F.transform("_chosen", pick))
    new = F.filter("_num", lambda p: ~F.exists(F.slice("_num", F.lit(1), p["sort_order"] - 1), lambda q: (
        q["player_id"].eqNullSafe(p["player_id"]) & q["player_name"].eqNullSafe(p["player_name"]))))
    return e.select("match_id", "team_id", "team_name", "_ord", F.slice(new, 1, XI_SIZE).alias("picks"))


#: Ways to a team's entry, best first.
BY_ID, BY_NAME, SOLE = range(3)


def xi_from_lineups(lineups_raw: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """The eleven of each of ``teams`` (``match_id, team_id, team_name``; None: the teams of the entries).

    A team takes its match's first entry with its id, else the first with its name (any
    case), else the only entry there is. An entry's eleven are its starters, else its first
    11 players; they are numbered, repeated (player id, name) leave gaps, and 11 stay.

    Entries are offered under keys (match, way, id or name), and only the first of a key is
    kept, so the join with the teams, each asking under its three keys, has no pairs to
    spare; one minimum over the ways decides. ``entry_way`` tells which it was.
    """
    picks = _entry_picks(lineups_raw)
    if teams is None:
        teams = picks.select("match_id", "team_id", "team_name").where(F.col("team_id").isNotNull()).distinct()

    def keys(by_name: Column) -> Column:
        ways = F.array(F.struct(F.lit(BY_ID).alias("way"), F.col("team_id").cast("string").alias("key")),
                       F.struct(F.lit(BY_NAME).alias("way"), by_name.alias("key")), F.struct(F.lit(SOLE).alias("way"), F.lit("").alias("key")))
        return F.explode(F.filter(ways, lambda k: k["key"].isNotNull())).alias("k")

    offers = (picks.select("match_id", keys(_name_key(F.col("team_name"))), "_ord", "picks").groupBy("match_id", "k.way", "k.key")
              .agg(F.count("*").alias("_n"), F.min_by("picks", "_ord").alias("picks")).where(f"way <> {SOLE} or _n = 1"))
    given = F.col("team_name").cast("string")
    wanted = teams.select(bigint_col(teams, "match_id").alias("match_id"), bigint_col(teams, "team_id").alias("team_id"), "team_name")
    asked = wanted.select("match_id", "team_id", "team_name", keys(F.when(given != "", _name_key(given)))).select("match_id", "team_id", "team_name", "k.way", "k.key")
    taken = (asked.join(offers, ["match_id", "way", "key"]).groupBy("match_id", "team_id", "team_name")
             .agg(F.min_by("picks", "way").alias("picks"), F.min("way").alias("entry_way")))
    return (taken.select("match_id", "team_id", "team_name", "entry_way", F.explode("picks").alias("p"))
            .select("match_id", "team_id", "team_name", "entry_way", "p.*").withColumn("source", F.lit("data_raw_lineups")))


# ---------------------------------------------------------------------------
# Greedy first eleven from events
# ---------------------------------------------------------------------------

def xi_from_events(events: DataFrame) -> DataFrame:
    """Chronological greedy pick of up to 11 players per (match, team).

    Rows of type 'Starting XI' and rows with a blank name are skipped; a row
    is taken when neither its player id nor its lower-cased name was taken
    before. Only the first row of each (player id, name) pair can matter, so
    the rows are first reduced to those pairs (a partial aggregation); the
    greedy fold then runs over the sorted pairs of one team, whose number is
    bounded by the squad, not by the number of events.
    """
    e = events
    keep = F.lit(True)
    if "type_name" in e.columns:
        keep = keep & F.coalesce(norm_text(F.col("type_name")) != "starting xi", F.lit(True))
    if "player_name" in e.columns:
        keep = keep & F.coalesce(F.trim(F.col("player_name").cast("string")) != "", F.lit(True))
    name = F.trim(F.coalesce(F.col("player_name").cast("string"), F.lit(""))) if "player_name" in e.columns \
        else F.lit("")
    order_parts = []
    for c in ("period", "minute", "second", "event_index"):
        if c in e.columns:
            v = bigint_col(e, c)
            order_parts += [v.isNull(), F.coalesce(v, F.lit(0))]
    if "event_id" in e.columns:
        order_parts.append(F.coalesce(F.col("event_id").cast("string"), F.lit("")))
    rows = e.where(keep).select(
        bigint_col(e, "match_id").alias("match_id"), bigint_col(e, "team_id").alias("team_id"),
        bigint_col(e, "player_id").alias("pid"), name.alias("pname"),
        (bigint_col(e, "position_id") if "position_id" in e.columns else F.lit(None).cast("bigint")).alias("position_id"),
        (F.col("position_name").cast("string") if "position_name" in e.columns else F.lit(None).cast("string"))
        .alias("position_name"),
        F.struct(*order_parts).alias("o"))
    rows = rows.where(F.col("pid").isNotNull() | (F.col("pname") != ""))
    pairs = (rows.groupBy("match_id", "team_id", "pid", F.lower("pname").alias("lname"))
                 .agg(F.min_by(F.struct("o", "pid", "pname", "position_id", "position_name"), "o").alias("r")))
    pairs = _pickable(pairs)
    per_team = pairs.groupBy("match_id", "team_id").agg(F.sort_array(F.collect_list("r")).alias("cands"))
    init = F.struct(F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("names"),
                    F.array().cast(per_team.schema["cands"].dataType).alias("picked"))

    def step(acc, c):
        lname = F.lower(c.getField("pname"))
        id_seen = c.getField("pid").isNotNull() & F.array_contains(acc.getField("ids"), c.getField("pid"))
        name_seen = (lname != "") & F.array_contains(acc.getField("names"), lname)
        take = (F.size(acc.getField("picked")) < XI_SIZE) & ~F.coalesce(id_seen, F.lit(False)) & ~name_seen
        return F.when(take, F.struct(
            F.when(c.getField("pid").isNotNull(), F.array_append(acc.getField("ids"), c.getField("pid")))
             .otherwise(acc.getField("ids")).alias("ids"),
            F.when(lname != "", F.array_append(acc.getField("names"), lname)).otherwise(acc.getField("names"))
             .alias("names"),
            F.array_append(acc.getField("picked"), c).alias("picked"))).otherwise(acc)

    folded = per_team.select("match_id", "team_id",
                             F.aggregate("cands", init, step).getField("picked").alias("picked"))
    out = folded.select("match_id", "team_id", F.posexplode("picked").alias("i", "r"))
    return out.select(
        "match_id", "team_id", F.col("r.pid").alias("player_id"),
        F.when(F.col("r.pname") != "", F.col("r.pname"))
         .otherwise(F.concat(F.lit("Player "), (F.col("i") + 1).cast("string"))).alias("player_name"),
        F.lit(None).cast("string").alias("jersey_number"), F.col("r.position_id").alias("position_id"),
        F.col("r.position_name").alias("position_name"), (F.col("i") + 1).alias("sort_order"),
        F.lit("events_fallback").alias("source"))


def _pickable(pairs: DataFrame) -> DataFrame:
    """The pairs of a team that the greedy rule can pick, and few others: at most
    k + 2k(k - 1) of them for an eleven of k = ``XI_SIZE``.

    A pair is blocked by an earlier pick with its id or its name. Say a pick has m
    earlier pairs of its id. None of these was taken, so each was blocked by its
    name, and as pairs are distinct these are m different names of picks: m < k.
    So every pick is among the first k pairs of its id, and likewise of its name.
    With only such pairs left, each of the at most k - 1 picks before the last one
    blocks at most 2(k - 1) others, so the last pick is among the first
    k + 2(k - 1)(k - 1) pairs. Leaving out pairs that are never picked changes no pick.
    """
    k = XI_SIZE

    def nth(*keys: str) -> Column:
        return F.row_number().over(Window.partitionBy("match_id", "team_id", *keys).orderBy("r.o"))

    near = (pairs.withColumn("_pid", F.col("r.pid")).withColumn("_i", nth("_pid")).withColumn("_n", nth("lname"))
            .where((F.col("_pid").isNull() | (F.col("_i") <= k)) & ((F.col("lname") == "") | (F.col("_n") <= k))))
    return near.withColumn("_k", nth()).where(F.col("_k") <= k + 2 * k * (k - 1)).drop("_pid", "_i", "_n", "_k")


def starting_xi(events: DataFrame, lineups_raw: DataFrame | None = None, teams: DataFrame | None = None) -> DataFrame:
    """W3 + W4: XI from lineup documents; teams that get none there use events. ``teams`` as in
    ``xi_from_lineups``; None: those of the events and of the entries."""
    from_events = xi_from_events(events)
    if lineups_raw is None:
        return from_events.select(*_XI_COLS)
    if teams is None:
        sources = [f.select(bigint_col(f, "match_id").alias("match_id"), bigint_col(f, "team_id").alias("team_id"),
                            (F.col("team_name").cast("string") if "team_name" in f.columns else F.lit(None).cast("string")).alias("team_name"))
                   for f in (events, lineups_raw)]
        teams = (sources[0].unionByName(sources[1]).where("match_id is not null and team_id is not null")
                 .groupBy("match_id", "team_id").agg(F.max("team_name").alias("team_name")))
    docs = xi_from_lineups(lineups_raw, teams).select(*_XI_COLS)
    covered = docs.select("match_id", "team_id").distinct()
    return docs.unionByName(from_events.join(covered, ["match_id", "team_id"], "left_anti").select(*_XI_COLS))


_XI_COLS = ["match_id", "team_id", "player_id", "player_name", "jersey_number", "position_id", "position_name",
            "sort_order", "source"]


# ---------------------------------------------------------------------------
# W7, W8, J12, W9
# ---------------------------------------------------------------------------

def formations(events: DataFrame) -> DataFrame:
    """Per (match, team) the first parseable formation of the team's first
    'Starting XI' event (columns tried in order)."""
    cols = [c for c in FORMATION_COLUMNS if c in events.columns]
    starts = events.where(F.coalesce(norm_text(F.col("type_name")) == "starting xi", F.lit(False)))
    parsed = [formation_text(F.col(c)) for c in cols]
    value = F.coalesce(*parsed) if parsed else F.lit(None).cast("string")
    order_parts = []
    for c in ("period", "minute", "second", "event_index"):
        if c in events.columns:
            v = bigint_col(events, c)
            order_parts += [v.isNull(), F.coalesce(v, F.lit(0))]
    order_parts.append(F.coalesce(F.col("event_id").cast("string"), F.lit("")) if "event_id" in events.columns
                       else F.lit(""))
    return (starts.select(bigint_col(events, "match_id").alias("match_id"),
                          bigint_col(events, "team_id").alias("team_id"), value.alias("formation"),
                          F.struct(*order_parts).alias("o"))
                  .groupBy("match_id", "team_id").agg(F.min_by("formation", "o").alias("formation")))


def starting_positions(xi: DataFrame, dim_match: DataFrame) -> DataFrame:
    """W8 + P17 + P18: pitch placement of the XI; home team mirrored
    (y = 100 - y); unmapped positions at (60, 66), flagged approximate."""
    spark = xi.sparkSession
    coords = F.broadcast(position_coords(spark))  # 25 static rows
    home = dim_match.select(bigint_col(dim_match, "match_id").alias("_m"),
                            bigint_col(dim_match, "home_team_id").alias("_home"))
    j = (xi.withColumn("pos_key", position_key(F.col("position_name")))
           .join(coords, "pos_key", "left")
           .join(home, F.col("match_id") == F.col("_m"), "left"))
    is_home = F.coalesce(F.col("team_id") == F.col("_home"), F.lit(False))
    y_up = F.coalesce(F.col("y_up"), F.lit(UNMAPPED_XY[1]))
    jersey = F.trim(F.col("jersey_number").cast("string"))
    return j.select(
        "match_id", "team_id", "player_id",
        F.coalesce(F.col("player_name"), F.lit("Unknown")).alias("player_name"), "jersey_number",
        F.when(jersey.isNotNull() & (jersey != ""), jersey.try_cast("double").try_cast("bigint").cast("string"))
         .otherwise(F.lit("?")).alias("jersey_text"),
        "position_id", "position_name",
        F.coalesce(F.col("x_up"), F.lit(UNMAPPED_XY[0])).alias("x"),
        F.when(is_home, 100.0 - y_up).otherwise(y_up).alias("y"),
        F.col("x_up").isNull().alias("approximate"), is_home.alias("is_home"))


def unmapped_positions(xi: DataFrame) -> DataFrame:
    """Distinct non-blank position names without coordinates, per match/team."""
    coords = F.broadcast(position_coords(xi.sparkSession))
    names = (xi.select("match_id", "team_id", F.trim(F.col("position_name").cast("string")).alias("position_name"))
               .where(F.col("position_name").isNotNull() & (F.col("position_name") != "")))
    return (names.withColumn("pos_key", position_key(F.col("position_name")))
                 .join(coords, "pos_key", "left_anti").drop("pos_key").distinct())


def xi_warnings(xi: DataFrame) -> DataFrame:
    """XI size different from 11, duplicated player names."""
    return (xi.groupBy("match_id", "team_id")
              .agg(F.count(F.lit(1)).alias("players"), F.countDistinct("player_name").alias("distinct_names"))
              .withColumn("size_warning", F.col("players") != XI_SIZE)
              .withColumn("duplicate_names", F.col("players") != F.col("distinct_names")))


def lineup_mirror(positions: DataFrame) -> DataFrame:
    """Mirrored marker frame (x = 120 - x, y = 80 - y); marker text is the
    jersey, else the first two letters of the name; short name of 18 chars."""
    name = F.coalesce(F.col("player_name").cast("string"), F.lit(""))
    jersey = F.col("jersey_text")
    return positions.select(
        "*", (120.0 - F.col("x")).alias("x_mirror"), (80.0 - F.col("y")).alias("y_mirror"),
        F.when(jersey.isNotNull() & (jersey != "?"), jersey).otherwise(F.substring(name, 1, 2))
         .alias("marker_text"),
        F.substring(name, 1, 18).alias("short_name"))
