"""Match, team and player report data (the frames behind the charts).

Every report is computed for all matches at once, keyed by ``match_id``
(plus team/player); a single match is a ``where`` on the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.coerce import bigint_col, coalesce_existing, double_col, int_col, norm_text
from touchline.functions.pitch import share_pct

# Shot outcome families (normalised, lower-case labels).
ON_TARGET_OUTCOMES = ("goal", "saved", "saved to post")
OFF_TARGET_OUTCOMES = ("off t", "wayward", "post")
BLOCKED_OUTCOMES = ("blocked",)
SHOT_TYPE_ID = 16
BIG_CHANCE_XG = 0.30


def _event_shots(fact_events: DataFrame) -> DataFrame:
    is_shot = F.lit(False)
    if "type_name" in fact_events.columns:
        is_shot = is_shot | F.coalesce(norm_text(F.col("type_name")) == "shot", F.lit(False))
    if "type_id" in fact_events.columns:
        is_shot = is_shot | F.coalesce(bigint_col(fact_events, "type_id") == SHOT_TYPE_ID, F.lit(False))
    return fact_events.where(is_shot)


def _shot_rows(df: DataFrame, src: int) -> DataFrame:
    outcome = coalesce_existing(df, ["shot_outcome", "shot_outcome_name"]).cast("string")
    xg = coalesce_existing(df, ["xg", "shot_statsbomb_xg"]).try_cast("double")
    oid = bigint_col(df, "shot_outcome_id") if "shot_outcome_id" in df.columns else F.lit(None).cast("bigint")
    return df.select(bigint_col(df, "match_id").alias("match_id"), bigint_col(df, "team_id").alias("team_id"),
                     outcome.alias("outcome"), oid.alias("outcome_id"), xg.alias("xg_value"), F.lit(src).alias("src"))


def match_stats(fact_events: DataFrame, fact_shots: DataFrame, dim_match: DataFrame) -> DataFrame:
    """A3: home/away pairs per match: shots, goals, on/off target, blocked, xG.

    Shots come from fact_shots; a match without shot rows falls back to its
    shot events. When no row of the match has an outcome label, labels are
    looked up from the match's shot events by outcome id; if still none, the
    outcome metrics are null. xG is the rounded (2) sum, null without rows.
    A match without home or away id only gets the official score as goals.
    """
    ev_shots = _event_shots(fact_events)
    fs = _shot_rows(fact_shots, 0) if "team_id" in fact_shots.columns else None
    es = _shot_rows(ev_shots, 1)
    rows = fs.unionByName(es) if fs is not None else es
    # aggregate first: everything below works on one row per
    # (match, team, label, outcome id, source) instead of one row per shot
    keyed = rows.groupBy("match_id", "team_id", "outcome", "outcome_id", "src").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("xg_value"), F.lit(0.0))).alias("xg_sum"))
    keyed = keyed.join(_outcome_labels(ev_shots), ["match_id", "outcome_id"], "left")
    dm = dim_match.select(bigint_col(dim_match, "match_id").alias("match_id"),
                          *[(bigint_col(dim_match, c) if c in dim_match.columns else F.lit(None).cast("bigint")).alias(c)
                            for c in ("home_team_id", "away_team_id", "home_score", "away_score")])

    # each match keeps its fact_shots rows, or its shot events when it has none, and its own labels, or the
    # looked-up ones when it has none; then one conditional aggregate a match, all on the same partitioning
    of_match = Window.partitionBy("match_id")
    keyed = (keyed.withColumn("_src", F.min("src").over(of_match)).where((F.col("src") == F.col("_src")) & F.col("team_id").isNotNull())
             .withColumn("_own", F.max(F.col("outcome").isNotNull()).over(of_match))
             .select(F.col("match_id").alias("_m"), "team_id", "n", "xg_sum", norm_text(F.when(F.col("_own"), F.col("outcome")).otherwise(F.col("mapped"))).alias("norm")))
    aggs = [F.sum("n").alias("rows"), F.count("norm").alias("labels")]
    for side in ("home", "away"):
        mine = F.col("team_id") == F.col(f"{side}_team_id")
        aggs += [F.sum(F.when(mine, F.col("n"))).alias(f"shots_{side}"), F.sum(F.when(mine, F.col("xg_sum"))).alias(f"xg_{side}")]
        aggs += [F.sum(F.when(mine & F.col("norm").isin(*labels), F.col("n"))).alias(f"{name}_{side}") for name, labels in _FAMILIES.items()]
    j = dm.join(keyed, F.col("match_id") == F.col("_m"), "left").groupBy(*dm.columns).agg(*aggs)
    ids_ok = F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull()

    def cnt(name: str, known: Column = F.lit(True)) -> Column:
        return F.when(ids_ok & known, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))

    out = {"shots_home": cnt("shots_home"), "shots_away": cnt("shots_away")}
    for name in _FAMILIES:
        for side in ("home", "away"):
            out[f"{name}_{side}"] = cnt(f"{name}_{side}", F.col("labels") > 0)
    for side in ("home", "away"):
        out[f"goals_{side}"] = F.when(ids_ok, out[f"goals_{side}"]).otherwise(F.col(f"{side}_score"))
        out[f"xg_{side}"] = F.when(ids_ok & (F.col("rows") > 0), F.round(F.coalesce(F.col(f"xg_{side}"), F.lit(0.0)), 2))
    return j.select(*dm.columns, *[c.alias(n) for n, c in out.items()])


#: Outcome metrics and their labels.
_FAMILIES = {"goals": ("goal",), "on_target": ON_TARGET_OUTCOMES, "off_target": OFF_TARGET_OUTCOMES, "blocked": BLOCKED_OUTCOMES}


def _outcome_labels(ev_shots: DataFrame) -> DataFrame:
    """``match_id, outcome_id, mapped``: the first non-empty label of each outcome id among a match's shot events."""
    if "shot_outcome_id" not in ev_shots.columns or not any(c in ev_shots.columns for c in ("shot_outcome", "shot_outcome_name")):
        return ev_shots.sparkSession.createDataFrame([], "match_id bigint, outcome_id bigint, mapped string")
    lab = coalesce_existing(ev_shots, ["shot_outcome", "shot_outcome_name"])
    ordc = F.struct(*[F.coalesce(bigint_col(ev_shots, c), F.lit(0)) for c in ("period", "minute", "second", "event_index") if c in ev_shots.columns],
                    F.col("event_id").cast("string") if "event_id" in ev_shots.columns else F.lit(""))
    return (ev_shots.select(bigint_col(ev_shots, "match_id").alias("match_id"), bigint_col(ev_shots, "shot_outcome_id").alias("outcome_id"),
                            F.trim(lab.cast("string")).alias("_lab"), ordc.alias("_o"))
            .where(F.col("outcome_id").isNotNull() & (F.col("_lab") != ""))
            .groupBy("match_id", "outcome_id").agg(F.min_by("_lab", "_o").alias("mapped")))


def goals_consistency(stats: DataFrame) -> DataFrame:
    """A4: computed goals vs the official score, one row per match."""
    return stats.select(
        "match_id", "goals_home", "goals_away", "home_score", "away_score",
        (F.col("goals_home").eqNullSafe(F.col("home_score")) & F.col("goals_away").eqNullSafe(F.col("away_score")))
        .alias("consistent"))


def stat_bar_shares(stats: DataFrame, metric: str) -> DataFrame:
    """P20: bar widths for one metric pair (50/50 when missing or total <= 0)."""
    left, right = share_pct(F.col(f"{metric}_home").cast("double"), F.col(f"{metric}_away").cast("double"))
    return stats.select("match_id", left.alias(f"{metric}_home_pct"), right.alias(f"{metric}_away_pct"))


def shot_kpis(shots_view: DataFrame, by: Sequence[str]) -> DataFrame:
    """A5: shots, total xG (null xG as 0), goals, distinct players."""
    return shots_view.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shots"),
        F.sum(F.coalesce(F.col("xg"), F.lit(0.0))).alias("total_xg"),
        F.count_if(F.col("is_goal")).alias("goals"),
        F.countDistinct("player_id").alias("players"),
    )


def shot_outcome_distribution(shots_view: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shots per outcome label (null -> 'Unknown')."""
    return (shots_view.withColumn("shot_outcome", F.coalesce(F.col("shot_outcome"), F.lit("Unknown")))
                      .groupBy(*by, "shot_outcome").agg(F.count(F.lit(1)).alias("count")))


def shot_timing(shots_view: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shots per minute (shots without a minute are not counted)."""
    return (shots_view.where(F.col("minute").isNotNull())
                      .groupBy(*by, "minute").agg(F.count(F.lit(1)).alias("shots")))


def cumulative_xg(shots_view: DataFrame, by: Sequence[str] = ("match_id", "team_id")) -> DataFrame:
    """xG per minute and its running total. The window runs over one row
    per (group, minute), so it stays small whatever the shot volume."""
    # a minute whose shots all lack xG contributes 0; shots without a minute are left out
    per_min = (shots_view.where(F.col("minute").isNotNull())
                         .groupBy(*by, "minute").agg(F.coalesce(F.sum("xg"), F.lit(0.0)).alias("xg")))
    w = Window.partitionBy(*by).orderBy(F.col("minute").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return per_min.withColumn("cum_xg", F.sum("xg").over(w))


def top_shooters(shots_view: DataFrame, by: Sequence[str] = ("match_id", "team_id"), n: int = 10) -> DataFrame:
    """Per group the top ``n`` named players by shots, then xG (ties by name).

    The ranking window sees one row per (group, player) after a partial
    aggregation, never raw shots.
    """
    per = (shots_view.where(F.col("player_name").isNotNull())
                     .groupBy(*by, "player_name")
                     .agg(F.count(F.lit(1)).alias("shots"),
                          F.coalesce(F.sum("xg"), F.lit(0.0)).alias("total_xg")))
    w = Window.partitionBy(*by).orderBy(F.col("shots").desc(), F.col("total_xg").desc_nulls_last(),
                                        F.col("player_name"))
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def shot_filters(shots_view: DataFrame, only_goals: bool = False, big_chances: bool = False,
                 open_play_only: bool = False) -> DataFrame:
    """goals only; big chances (xG >= 0.30, null as 0); open play (play
    pattern 'regular play', else shot type not penalty / free kick)."""
    out = shots_view
    if only_goals:
        out = out.where(F.col("is_goal"))
    if big_chances:
        out = out.where(F.coalesce(F.col("xg"), F.lit(0.0)) >= BIG_CHANCE_XG)
    if open_play_only:
        if "play_pattern_name" in out.columns:
            out = out.where(F.coalesce(F.lower(F.col("play_pattern_name")) == "regular play", F.lit(False)))
        elif "shot_type" in out.columns:
            st = F.lower(F.coalesce(F.col("shot_type"), F.lit("none")))
            out = out.where(~st.isin("penalty", "free kick"))
    return out


def shot_map_frame(shots_view: DataFrame, xg_null_as_zero: bool = True) -> DataFrame:
    """P21 + P19: plottable shots with goal flag, outcome text, marker sizes and the texts shown
    for a marker (``-`` where unknown)."""
    xg = F.coalesce(F.col("xg"), F.lit(0.0)) if xg_null_as_zero else F.col("xg")
    return (shots_view.where(F.col("x").isNotNull() & F.col("y").isNotNull())
                      .withColumn("xg_plot", xg)
                      .withColumn("outcome_text", F.coalesce(F.col("shot_outcome"), F.lit("Unknown")))
                      .withColumn("marker_size", 7 + 26 * F.col("xg_plot"))
                      .withColumn("marker_area", 80 + 1400 * F.greatest(F.col("xg_plot"), F.lit(0.0)))
                      .withColumns({name: F.coalesce(coalesce_existing(shots_view, [c]).cast("string"), F.lit("-"))
                                    for name, c in (("minute_text", "minute"), ("player_text", "player_name"), ("shot_type_text", "shot_type"),
                                                    ("body_part_text", "body_part"))})
                      .withColumn("xg_text", (F.rint(F.coalesce(F.col("xg"), F.lit(0.0)) * 100) / 100).cast("string")))


def team_heatmap(events: DataFrame, bins: tuple[int, int] = (12, 8), by: Sequence[str] = ("match_id", "team_id"),
                 pitch: tuple[float, float] = (120.0, 80.0)) -> DataFrame:
    """Touches per grid cell (12 x 8 by default); off-pitch rows dropped."""
    x, y = double_col(events, "location_x"), double_col(events, "location_y")
    nx, ny = bins
    bx = F.least(F.floor(x / pitch[0] * nx), F.lit(nx - 1)).cast("int")
    by_ = F.least(F.floor(y / pitch[1] * ny), F.lit(ny - 1)).cast("int")
    keys = [bigint_col(events, c).alias(c) for c in by]
    return (events.where(x.between(0, pitch[0]) & y.between(0, pitch[1]))
                  .select(*keys, bx.alias("bin_x"), by_.alias("bin_y"))
                  .groupBy(*by, "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("touches")))


def _network_passes(passes: DataFrame, passer_col: str, receiver_col: str) -> DataFrame:
    return (passes.select(bigint_col(passes, "match_id").alias("match_id"),
                          bigint_col(passes, "team_id").alias("team_id"),
                          bigint_col(passes, passer_col).alias("passer"),
                          bigint_col(passes, receiver_col).alias("receiver"),
                          double_col(passes, "location_x").alias("x"), double_col(passes, "location_y").alias("y"))
                  .where(F.col("passer").isNotNull() & F.col("receiver").isNotNull() & F.col("x").isNotNull()
                         & F.col("y").isNotNull()))


def pass_network_nodes(passes: DataFrame, passer_col: str = "player_id",
                       receiver_col: str = "pass_recipient_id") -> DataFrame:
    """A9 nodes: mean pass start position and pass count per passer, plus the
    node size encoding (P19) relative to the team's busiest passer."""
    p = _network_passes(passes, passer_col, receiver_col)
    nodes = p.groupBy("match_id", "team_id", "passer").agg(F.avg("x").alias("x"), F.avg("y").alias("y"),
                                                          F.count(F.lit(1)).alias("touches"))
    w = Window.partitionBy("match_id", "team_id")
    return (nodes.withColumnRenamed("passer", "player_id")
                 .withColumn("node_size", 120 + 900 * F.col("touches") / F.max("touches").over(w)))


def pass_network_edges(passes: DataFrame, passer_col: str = "player_id",
                       receiver_col: str = "pass_recipient_id") -> DataFrame:
    """A9 edges + J11: pass counts per (passer, receiver), kept only when both
    ends are passers of the team; width encoding relative to the max edge."""
    p = _network_passes(passes, passer_col, receiver_col)
    edges = p.groupBy("match_id", "team_id", "passer", "receiver").agg(F.count(F.lit(1)).alias("pass_count"))
    nodes = p.select("match_id", "team_id", "passer").distinct()
    b = nodes.select("match_id", "team_id", F.col("passer").alias("_pb"))
    # the passer of a pass is a passer; only the receiver has to be looked up
    edges = edges.join(b, (edges["match_id"] == b["match_id"]) & (edges["team_id"] == b["team_id"])
                       & (edges["receiver"] == b["_pb"]), "left_semi").where(F.col("passer").isNotNull())
    w = Window.partitionBy("match_id", "team_id")
    return edges.withColumn("edge_width", 0.5 + 3 * F.col("pass_count") / F.max("pass_count").over(w))


def defensive_actions_by_type(actions: DataFrame) -> DataFrame:
    """A10: defensive actions per (match, team, type) with a plottable location."""
    x, y = double_col(actions, "location_x"), double_col(actions, "location_y")
    return (actions.where(x.isNotNull() & y.isNotNull())
                   .groupBy(bigint_col(actions, "match_id").alias("match_id"),
                            bigint_col(actions, "team_id").alias("team_id"), F.col("type_name"))
                   .agg(F.count(F.lit(1)).alias("actions"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y")))


def latest_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """T2 generalised: newest ``max(1, n)`` rows per group (order given)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= max(1, n)).drop("_rk")
