"""Coordinate normalisation (P10), away-shot mirroring (P11), bounds check (Q5).

The home team of each event comes from a join to ``dim_match`` (one row per
match) instead of a scalar, so every match is normalised in the same job. The
join is a plain equi-join: AQE turns it into a broadcast join when the
runtime size of ``dim_match`` is under the broadcast threshold and keeps a
shuffle join beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.coerce import bigint_col, double_col
from touchline.functions.pitch import PITCH_LENGTH, PITCH_WIDTH, normalise_x, normalise_y

# Coordinate columns handled by default.
DEFAULT_X_COLUMNS = ("location_x", "pass_end_location_x", "carry_end_location_x", "shot_end_location_x")
DEFAULT_Y_COLUMNS = ("location_y", "pass_end_location_y", "carry_end_location_y", "shot_end_location_y")


def _home_lookup(dim_match: DataFrame) -> DataFrame:
    return dim_match.select(bigint_col(dim_match, "match_id").alias("_m"),
                            bigint_col(dim_match, "home_team_id").alias("_home_team_id"))


def normalize_event_coordinates(events: DataFrame, dim_match: DataFrame, pitch_length: float = PITCH_LENGTH,
                                pitch_width: float = PITCH_WIDTH, team_id_col: str = "team_id",
                                x_columns: Sequence[str] = DEFAULT_X_COLUMNS,
                                y_columns: Sequence[str] = DEFAULT_Y_COLUMNS) -> DataFrame:
    """P10: x, y to 0-100 (clamped, rounded to 6); x mirrored for non-home teams.

    A null team (or a match without a home team) is never mirrored; y is never
    mirrored. Columns that are absent are skipped; other columns pass through.
    """
    home = _home_lookup(dim_match)
    j = events.join(home, bigint_col(events, "match_id") == home["_m"], "left")
    team = bigint_col(events, team_id_col)
    flip = team.isNotNull() & (team != F.col("_home_team_id"))
    repl = {}
    for c in x_columns:
        if c in events.columns:
            repl[c] = normalise_x(double_col(events, c), flip, pitch_length)
    for c in y_columns:
        if c in events.columns:
            repl[c] = normalise_y(double_col(events, c), pitch_width)
    return j.withColumns(repl).drop("_m", "_home_team_id")


def orient_shots_to_home(shots: DataFrame, dim_match: DataFrame, x_col: str = "x", y_col: str = "y") -> DataFrame:
    """Shots of the away team mirrored (x = 120 - x, y = 80 - y)."""
    m = dim_match.select(bigint_col(dim_match, "match_id").alias("_m"),
                         bigint_col(dim_match, "away_team_id").alias("_away"))
    j = shots.join(m, bigint_col(shots, "match_id") == m["_m"], "left")
    away = F.coalesce(bigint_col(shots, "team_id") == F.col("_away"), F.lit(False))
    return (j.withColumn(x_col, F.when(away, PITCH_LENGTH - F.col(x_col)).otherwise(F.col(x_col)))
             .withColumn(y_col, F.when(away, PITCH_WIDTH - F.col(y_col)).otherwise(F.col(y_col)))
             .drop("_m", "_away"))


def coordinate_bound_issues(events: DataFrame, x_columns: Sequence[str] = DEFAULT_X_COLUMNS,
                            y_columns: Sequence[str] = DEFAULT_Y_COLUMNS, lower: float = 0.0,
                            upper: float = 100.0) -> DataFrame:
    """Q5: one row per coordinate outside [lower, upper], keyed by event id."""
    cols = [c for c in list(x_columns) + list(y_columns) if c in events.columns]
    keys = [c for c in ("match_id", "event_id") if c in events.columns]
    if not cols:
        return events.select(*keys, F.lit(None).cast("string").alias("column_name"),
                             F.lit(None).cast("double").alias("value"),
                             F.lit(None).cast("string").alias("issue")).where(F.lit(False))
    typed = events.select(*keys, *[double_col(events, c).alias(c) for c in cols])
    long = typed.unpivot(keys, cols, "column_name", "value")
    return (long.where((F.col("value") < lower) | (F.col("value") > upper))
                .withColumn("issue", F.format_string("%s out of bounds (%s)", F.col("column_name"),
                                                     F.col("value").cast("string"))))
