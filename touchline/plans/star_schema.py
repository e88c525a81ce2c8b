"""L2: processed tables -> star schema (16 dims, 5 facts), plus the export
contract checks (Q7-Q9).

Each table is one query that reads only its columns of the processed tables; the
nine small dims share one pass over the events, whose result, a row per id, is
staged. Row counts, null ids and repeated keys are observed while a table is
written, so nothing is read again. The new model is written beside the old one
and takes its place only if the contract holds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.coerce import bigint_col
from touchline.operators import model, quality
from touchline.session import staged
from touchline.sources.json_files import ingest_order
from touchline.sources.tables import read_table

# Fact layout: fact_events is partitioned by competition and season (a few
# thousand folders at full scale, pruned by the usual report filters) and
# sorted by match inside each partition, so Parquet row-group statistics prune
# a match_id predicate; the other facts are range-partitioned by match.
PARTITION_COLUMNS = {"fact_events": ["competition_id", "season_id"]}
MATCH_SORTED = {"fact_events", "fact_shots", "fact_lineups_players", "fact_three_sixty",
                "fact_three_sixty_freeze_frames"}


def build_model(spark: SparkSession, processed_dir: str) -> dict[str, DataFrame]:
    """All model tables as lazy DataFrames (only the stacked small dims are staged)."""
    t = {name: read_table(spark, processed_dir, name) for name in
         ("events", "competitions", "matches", "lineups_players", "three_sixty", "three_sixty_freeze_frames",
          "three_sixty_visible_area", "teams", "players")}
    out: dict[str, DataFrame] = {}
    comps = t["competitions"]
    if comps is not None:
        c = comps.withColumn("_ord", ingest_order())
        cols = ["competition_name", "country_name", "competition_gender", "competition_youth",
                "competition_international"]
        comp = c.select(bigint_col_safe(c, "competition_id").alias("competition_id"),
                        *[F.trim(F.coalesce(F.col(x).cast("string"), F.lit(""))).alias(x) if x in c.columns
                          else F.lit("").alias(x) for x in cols], "_ord")
        out["dim_competition"] = model.first_row_per_key(comp, "competition_id", "_ord").drop("_ord")
        seas = c.select(bigint_col_safe(c, "season_id").alias("season_id"),
                        F.trim(F.coalesce(F.col("season_name").cast("string"), F.lit(""))).alias("season_name")
                        if "season_name" in c.columns else F.lit("").alias("season_name"), "_ord")
        out["dim_season"] = model.first_row_per_key(seas, "season_id", "_ord").drop("_ord")
    matches = t["matches"]
    ids_360 = model.three_sixty_match_ids(t["three_sixty_visible_area"], t["three_sixty"])
    if matches is not None:
        m = matches.withColumn("_ord", ingest_order())
        out["dim_match"] = model.dim_match(m, "_ord", ids_360)
    teams = t["teams"].withColumn("_ord", F.lit(0)) if t["teams"] is not None else None
    lineups = t["lineups_players"].withColumn("_ord", ingest_order()) if t["lineups_players"] is not None else None
    mts = matches.withColumn("_ord", ingest_order()) if matches is not None else None
    if teams is not None or mts is not None or lineups is not None:
        out["dim_team"] = model.dim_team(teams, mts, lineups)
    players = t["players"].withColumn("_ord", F.lit(0)) if t["players"] is not None else None
    if players is not None or lineups is not None:
        out["dim_player"] = model.dim_player(players, lineups)
    out["dim_zone"] = model.dim_zone(spark)
    ev = t["events"]
    if ev is not None:
        ev = ev.withColumn("_ord", ingest_order())
        dm = out.get("dim_match", spark.createDataFrame([], "match_id bigint, competition_id bigint, "
                                                             "season_id bigint"))
        out["fact_events"] = model.fact_events(ev, dm, "_ord")
        out["fact_shots"] = model.fact_shots(ev, "_ord")
        out["dim_time"] = model.dim_time(ev)
        stacked = staged(model.small_dims_stacked(ev, "_ord"), "small-dims")
        for dim, *_ in model.SMALL_DIMS:
            out[dim] = model.small_dim(stacked, dim)
    if t["lineups_players"] is not None:
        out["fact_lineups_players"] = model.fact_lineups_players(t["lineups_players"])
    if t["three_sixty_visible_area"] is not None or t["three_sixty"] is not None:
        out["fact_three_sixty"] = model.fact_three_sixty(t["three_sixty_visible_area"], t["three_sixty"])
    if t["three_sixty_freeze_frames"] is not None:
        out["fact_three_sixty_freeze_frames"] = model.fact_three_sixty_freeze_frames(t["three_sixty_freeze_frames"])
    return out


def bigint_col_safe(df: DataFrame, name: str):
    return bigint_col(df, name) if name in df.columns else F.lit(None).cast("bigint")


class ModelRejected(Exception):
    """The new model breaks its contract and was not published; ``failed`` names the rules."""

    def __init__(self, failed: list[str]):
        super().__init__("model not published: " + "; ".join(failed))
        self.failed = failed


@dataclass
class Observed:
    """What was seen of a table while it was written."""

    rows: int
    null_ids: dict[str, int]
    repeated_keys: int


def _watched(name: str, df: DataFrame) -> tuple[DataFrame, list[Column], Column | None]:
    """``df`` ready for its metrics: null ids of fact_shots, and for a dimension a row number per key (its
    query grouped by the key, so the window finds the rows where they are)."""
    if name.startswith("dim_"):
        key = df.columns[0]
        return (df.withColumn("_nth", F.row_number().over(Window.partitionBy(F.col(key)).orderBy(F.col(key)))),
                [], F.col("_nth") == 2)
    nulls = [c for c in quality.FACT_SHOT_ID_COLUMNS if name == "fact_shots" and c in df.columns]
    return df, [F.count_if(bigint_col(df, c).isNull()).alias(f"null_{c}") for c in nulls], None


def write_observed(df: DataFrame, name: str, path: str, output_format: str) -> Observed:
    """Writes one model table and returns what was counted on the way; nothing is read back.

    Facts are range-partitioned on (partition columns, match, a row-level tie), which splits
    a hot match over several sorted files. The metrics sit above that shuffle: the
    pass that samples the ranges does not count.
    """
    df, metrics, repeated = _watched(name, df)
    parts = [c for c in PARTITION_COLUMNS.get(name, []) if c in df.columns]
    tie = [c for c in ("event_id", "event_uuid", "player_id") if c in df.columns][:1]
    if (parts or name in MATCH_SORTED) and "match_id" in df.columns:
        df = df.repartitionByRange(*parts, "match_id", *tie).sortWithinPartitions(*parts, "match_id", *tie)
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(repeated if repeated is not None else F.lit(False)).alias("repeated"), *metrics)
    writer = df.drop("_nth").write.mode("overwrite")
    writer = writer.partitionBy(*parts) if parts else writer
    if output_format == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.option("compression", "snappy").parquet(path)
    got = seen.get
    return Observed(got["rows"], {k[5:]: v for k, v in got.items() if k.startswith("null_")}, got["repeated"])


def broken_rules(spark: SparkSession, tables: dict[str, DataFrame], observed: dict[str, Observed]) -> list[str]:
    """Q7, Q9: rules of the fact_shots contract (columns) and dimensions with repeated keys (as counted)."""
    failed = []
    if "fact_shots" in tables:
        failed += quality.broken_contract(tables["fact_shots"])
    return failed + [f"duplicate keys {name}" for name, o in observed.items() if o.repeated_keys]


def export_star_schema(spark: SparkSession, processed_dir: str, output_dir: str, output_format: str = "parquet",
                       tables: dict[str, DataFrame] | None = None) -> dict[str, int]:
    """K2, K6: writes every model table and the model notes; returns rows per table (Q3), counted while writing.

    Everything is written below ``_next-<id>`` of the output folder. Only if no rule is broken
    (else ``ModelRejected``, and the old model stays as it is) the tables change places with the
    old ones, by renames. A run that dies before leaves the old model and a folder that
    the next run clears away.
    """
    tables = build_model(spark, processed_dir) if tables is None else tables
    base = output_dir.rstrip("/")
    files = _Files(spark)
    for left in files.children(base, "_next-"):
        files.delete(left)
    new = f"{base}/_next-{uuid.uuid4().hex[:12]}"
    observed = {name: write_observed(df, name, f"{new}/{name}", output_format) for name, df in tables.items()}
    if failed := broken_rules(spark, tables, observed):
        files.delete(new)
        raise ModelRejected(failed)
    for name, df in zip(("_notes/grains", "_notes/relationships"), model.model_notes(spark), strict=True):
        df.coalesce(1).write.json(f"{new}/{name}")
    names = [*tables, "_notes"]
    for name in names:
        files.replace(f"{new}/{name}", f"{base}/{name}")
    files.delete(new)
    return {name: o.rows for name, o in observed.items()}


class _Files:
    """Renames and deletions through the Hadoop file system of a path."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def children(self, path: str, prefix: str) -> list[str]:
        fs, p = self._at(path)
        found = fs.listStatus(p) if fs.exists(p) else []
        return [f.getPath().toString() for f in found if f.getPath().getName().startswith(prefix)]

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def replace(self, source: str, target: str) -> None:
        """``source`` takes the place of ``target``, which is deleted only after it is out of the way."""
        fs, src = self._at(source)
        _, dst = self._at(target)
        _, old = self._at(f"{source}-old")
        if fs.exists(dst) and not fs.rename(dst, old):
            raise OSError(f"cannot move {target}")
        fs.mkdirs(dst.getParent())
        if not fs.rename(src, dst):
            fs.rename(old, dst)
            raise OSError(f"cannot publish {target}")
        fs.delete(old, True)


#: Every table a model folder may hold.
MODEL_TABLES = ("dim_competition", "dim_season", "dim_match", "dim_team", "dim_player", "dim_zone", "dim_time",
                *[d for d, *_ in model.SMALL_DIMS], "fact_events", "fact_shots", "fact_lineups_players",
                "fact_three_sixty", "fact_three_sixty_freeze_frames")


def load_model(spark: SparkSession, model_dir: str) -> dict[str, DataFrame]:
    """The tables of an exported model that are there."""
    found = {name: read_table(spark, model_dir, name) for name in MODEL_TABLES}
    return {name: df for name, df in found.items() if df is not None}


def export_checks(spark: SparkSession, model_tables: dict[str, DataFrame]) -> DataFrame:
    """Q7-Q9 at export time: fact_shots contract, null id counts, duplicate dim keys."""
    fs = model_tables["fact_shots"]
    contract = quality.fact_shots_contract(spark, fs).select(
        "check", F.when(F.col("passed"), 0).otherwise(1).cast("bigint").alias("value"))
    nulls = quality.null_id_counts(fs).select(F.concat(F.lit("null "), F.col("column")).alias("check"),
                                              F.col("null_ids").alias("value"))
    dims = {n: (df, df.columns[0]) for n, df in model_tables.items() if n.startswith("dim_")}
    dup = quality.duplicate_dim_keys(dims).select(F.concat(F.lit("duplicate keys "), F.col("dim")).alias("check"),
                                                  F.col("duplicate_keys").alias("value"))
    return contract.unionByName(nulls).unionByName(dup)
