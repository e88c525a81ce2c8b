"""Data quality (Q1-Q4) and model validation (Q6-Q12, J8, J9) as DataFrames.

Each check is a DataFrame of rows; a whole table's check is one aggregation
pass (no per-column loops over data). Driver-side work is limited to schema
inspection and formatting a handful of result rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.coerce import bigint_col, norm_text
from touchline.operators.model import duplicate_extra_rows

# fact_shots contract.
FACT_SHOT_ID_COLUMNS = ("shot_outcome_id", "body_part_id", "shot_type_id")
FACT_SHOT_FORBIDDEN_COLUMNS = ("shot_outcome", "shot_outcome_name", "shot_type", "shot_type_name", "body_part",
                               "body_part_name")


def key_null_rates(df: DataFrame, table: str, key_columns: Sequence[str], sample_rows: int | None = None) -> DataFrame:
    """Q1: per key column the share of null or '' values, as rows
    ``(table, column, null_rows, checked_rows, null_rate)``; ``null_rate`` is
    'x.xx%', 'column missing', or 'not computed' when nothing was checked.
    ``sample_rows`` checks only the first N rows (a sampling feature)."""
    spark = df.sparkSession
    src = df.limit(sample_rows) if sample_rows else df
    present = [c for c in key_columns if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in present:
        blank = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        aggs.append(F.count_if(blank).alias(c))
    schema = "table string, column string, null_rows bigint, checked_rows bigint"
    missing = [(table, c, None, None) for c in key_columns if c not in present]
    out = spark.createDataFrame(missing, schema) if missing or not present else None
    if present:
        # one aggregation pass for all columns, then one row per column
        counts = (src.agg(*aggs)
                     .unpivot(["_n"], [F.col(f"`{c}`").alias(c) for c in present], "column", "null_rows")
                     .select(F.lit(table).alias("table"), "column", F.col("null_rows").cast("bigint"),
                             F.col("_n").cast("bigint").alias("checked_rows")))
        out = counts if out is None else counts.unionByName(out)
    rate = F.format_string("%.2f%%", F.col("null_rows") * 100.0 / F.col("checked_rows"))
    return out.withColumn("null_rate", F.when(F.col("null_rows").isNull(), F.lit("column missing"))
                          .when(F.col("checked_rows") == 0, F.lit("not computed")).otherwise(rate))


def required_columns_check(spark: SparkSession, tables: Mapping[str, DataFrame],
                           required: Mapping[str, Sequence[str]]) -> DataFrame:
    """Q2: (table, column, present) for every required column (schema only)."""
    rows = [(t, c, c in tables[t].columns) for t in tables for c in required.get(t, [])]
    return spark.createDataFrame(rows, "table string, column string, present boolean")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Q3: (table, rows) -- one count aggregation per table, unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_summary(listing: DataFrame, to_process: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Q4: files found / skipped unchanged / processed / failed per processor."""
    found = listing.groupBy("processor").agg(F.count(F.lit(1)).alias("found"))
    proc = to_process.groupBy("processor").agg(F.count(F.lit(1)).alias("processed"))
    failed = quarantine.groupBy("processor").agg(F.countDistinct("path").alias("failed"))
    out = found.join(proc, "processor", "left").join(failed, "processor", "left").fillna(0, ["processed", "failed"])
    return out.withColumn("skipped_unchanged", F.col("found") - F.col("processed"))


# ---------------------------------------------------------------------------
# Model validation
# ---------------------------------------------------------------------------

def fk_violations(fact: DataFrame, checks: Sequence[tuple[str, DataFrame, str]], fact_name: str = "fact") -> DataFrame:
    """Non-null fact keys absent from the dimension, one row per check.

    Each check is a ``left_anti`` join on BIGINT keys (skew-safe: the anti
    join streams the fact side; AQE broadcasts a small dimension).
    """
    parts = []
    for fact_key, dim, dim_key in checks:
        if fact_key not in fact.columns:
            continue
        # a key that is there but no number refers to nothing, so it counts too
        f = fact.where(F.col(fact_key).isNotNull()).select(bigint_col(fact, fact_key).alias("_k"))
        d = dim.select(bigint_col(dim, dim_key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
        parts.append(f.join(d, "_k", "left_anti").agg(F.count(F.lit(1)).alias("violations"))
                      .select(F.lit(f"{fact_name}.{fact_key}").alias("check"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_outcome_labels(fact_shots: DataFrame, dim_shot_outcome: DataFrame) -> DataFrame:
    """Shot rows with an outcome id but no (non-blank) label in the dimension."""
    d = dim_shot_outcome.select(bigint_col(dim_shot_outcome, "shot_outcome_id").alias("_k"),
                                F.col("shot_outcome_name").alias("_n"))
    f = fact_shots.select(bigint_col(fact_shots, "shot_outcome_id").alias("_k"),
                          F.col("shot_outcome_id").isNotNull().alias("_has"))
    j = f.join(d, "_k", "left")
    return j.agg(F.count_if(F.col("_has") & (F.trim(F.coalesce(F.col("_n"), F.lit(""))) == ""))
                 .alias("missing_labels"))


def null_id_counts(fact_shots: DataFrame, columns: Sequence[str] = ("shot_outcome_id", "body_part_id",
                                                                    "shot_type_id")) -> DataFrame:
    """Q8: rows whose id does not parse as BIGINT, per id column (one pass)."""
    present = [c for c in columns if c in fact_shots.columns]
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count_if(bigint_col(fact_shots, c).isNull()).alias(c)
                                                 for c in present]
    return fact_shots.agg(*aggs).unpivot(["rows"], present, "column", "null_ids")


def duplicate_dim_keys(dims: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Q9: number of keys occurring more than once, per dimension."""
    parts = []
    for name, (df, key) in dims.items():
        g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        parts.append(g.agg(F.count(F.lit(1)).alias("duplicate_keys")).select(F.lit(name).alias("dim"),
                                                                            "duplicate_keys"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fact_shots_contract(spark: SparkSession, fact_shots: DataFrame) -> DataFrame:
    """Q7: canonical id columns present, label columns absent (schema only)."""
    broken = set(broken_contract(fact_shots))
    return spark.createDataFrame([(rule, rule not in broken) for rule in _CONTRACT], "check string, passed boolean")


#: The rules of the contract, by name.
_CONTRACT = {**{f"has {c}": (c, True) for c in FACT_SHOT_ID_COLUMNS}, **{f"no {c}": (c, False) for c in FACT_SHOT_FORBIDDEN_COLUMNS}}


def broken_contract(fact_shots: DataFrame) -> list[str]:
    """Q7: the rules that the columns of fact_shots break."""
    there = {c.lower() for c in fact_shots.columns}
    return [rule for rule, (column, wanted) in _CONTRACT.items() if (column in there) != wanted]


def goal_consistency(fact_shots: DataFrame, dim_shot_outcome: DataFrame, match_id: int | None = None,
                     team_id: int | None = None, player_id: int | None = None) -> DataFrame:
    """Q11: goals counted by label name vs by goal outcome ids, one pass.

    By name, a shot counts once for every dimension row of its id whose label is
    'goal', so a dimension that repeats an id shows as a mismatch; by id, once
    if its id is among the ids so labelled.
    """
    f = fact_shots
    if match_id is not None:
        f = f.where(bigint_col(f, "match_id") == int(match_id))
    if team_id is not None and "team_id" in f.columns:
        f = f.where(bigint_col(f, "team_id") == int(team_id))
    if player_id is not None and "player_id" in f.columns:
        f = f.where(bigint_col(f, "player_id") == int(player_id))
    d = dim_shot_outcome.select(bigint_col(dim_shot_outcome, "shot_outcome_id").alias("_k"),
                                norm_text(F.coalesce(F.col("shot_outcome_name"), F.lit(""))).alias("_n"))
    goal_ids = d.where(F.col("_n") == "goal").select(F.col("_k").alias("_g")).distinct()
    j = (f.select(bigint_col(f, "shot_outcome_id").alias("_k"))
          .join(d.groupBy("_k").agg(F.sum((F.col("_n") == "goal").cast("int")).alias("_by_name")), "_k", "left")
          .join(goal_ids, F.col("_k") == F.col("_g"), "left"))
    return j.agg(F.coalesce(F.sum("_by_name"), F.lit(0)).cast("bigint").alias("goals_by_name"),
                 F.count_if(F.col("_g").isNotNull()).alias("goals_by_id"))


def validate_model(spark: SparkSession, model: Mapping[str, DataFrame], match_id: int | None = None, team_id: int | None = None,
                   player_id: int | None = None) -> DataFrame:
    """Q12: all checks as rows ``(check, status, value)``; overall status last. A match,
    team or player narrows the goal check, as in ``goal_consistency``."""
    fs = model["fact_shots"]
    rows = []
    dup = duplicate_extra_rows(fs, ["match_id", "event_id"]).select(
        F.lit("fact_shots unique (match_id, event_id)").alias("check"),
        F.col("duplicate_rows").alias("value"))
    rows.append(dup)
    contract = fact_shots_contract(spark, fs).select(
        "check", F.when(F.col("passed"), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("value"))
    rows.append(contract)
    if "shot_outcome_id" in fs.columns:
        rows.append(missing_outcome_labels(fs, model["dim_shot_outcome"])
                    .select(F.lit("outcome labels available").alias("check"),
                            F.col("missing_labels").alias("value")))
    fk = fk_violations(fs, [("match_id", model["dim_match"], "match_id"), ("team_id", model["dim_team"], "team_id"),
                            ("player_id", model["dim_player"], "player_id")], "fact_shots")
    rows.append(fk.select(F.concat(F.lit("fk "), F.col("check")).alias("check"), F.col("violations").alias("value")))
    for c in ("shot_outcome_id", "body_part_id"):
        if c in fs.columns:
            rows.append(fs.agg(F.count_if(bigint_col(fs, c).isNull()).alias("value"))
                          .select(F.lit(f"{c} populated").alias("check"), "value"))
    if "shot_outcome_id" in fs.columns:
        g = goal_consistency(fs, model["dim_shot_outcome"], match_id, team_id, player_id)
        rows.append(g.select(F.lit("goal name/id consistency").alias("check"),
                             F.abs(F.col("goals_by_name") - F.col("goals_by_id")).alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    out = out.withColumn("status", F.when(F.col("value") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")))
    overall = out.agg(F.sum(F.when(F.col("status") == "FAIL", 1).otherwise(0)).cast("bigint").alias("value")).select(
        F.lit("overall").alias("check"), "value",
        F.when(F.col("value") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"))
    return out.unionByName(overall)
