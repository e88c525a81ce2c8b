"""L1: raw JSON folders -> processed Parquet tables, incrementally.

Steps per processor: list files (S2) -> drop files whose fingerprint (size and
mtime, or sha1) matches the manifest (I1, unless ``force``) -> read + flatten
(S1, P1-P4, A21, A22) -> write (K1) -> record quarantined files (K4). Then the
teams/players dims (A18) are rebuilt from the previous dims plus the new rows,
and only after that are the manifest rows of the files that succeeded appended
(I2), so a run that dies in between is repeated, not forgotten. The quality
tables (Q1-Q4) are written next to the data.

Layout: every table is partitioned by ``_bucket``, a hash of the source file's
path into a fixed number of buckets. A changed file replaces exactly its own
rows: the buckets it touches are rewritten as their other files' rows plus the
new ones. Column types are the same in every run (``ingest.stored``).
"""

from __future__ import annotations

import datetime as _dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import ingest, quality
from touchline.session import checkpoint_dir, staged
from touchline.sources import json_files
from touchline.sources.tables import read_parquet

# Processor -> output tables.
PROCESSOR_TABLES = {
    "events": ["events"],
    "competitions": ["competitions"],
    "matches": ["matches"],
    "lineups": ["lineups_players", "lineup_entries"],
    "three-sixty": ["three_sixty", "three_sixty_freeze_frames", "three_sixty_visible_area"],
}
#: Folders of a table: bounded however many files there are.
BUCKETS = 256
#: Files that one read names (and the driver holds) at a time, as far as whole buckets allow.
FILES_A_READ = 10_000


@dataclass
class EtlResult:
    run_id: str
    processed_files: dict[str, int] = field(default_factory=dict)
    tables: dict[str, str] = field(default_factory=dict)


def _path(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


def read_manifest(spark: SparkSession, output_dir: str) -> DataFrame | None:
    """Current state: the latest manifest row per (processor, path)."""
    m = read_parquet(spark, _path(output_dir, "_manifest"))
    if m is None:
        return None
    if "sha1" not in m.columns:
        m = m.withColumn("sha1", F.lit(None).cast("string"))
    return (m.groupBy("processor", "path")
             .agg(F.max_by(F.struct("size_bytes", "mtime", "sha1"), "recorded_at").alias("s"))
             .select("processor", "path", "s.size_bytes", "s.mtime", "s.sha1"))


def changed_files(listing: DataFrame, manifest: DataFrame | None, force: bool = False,
                  by_content: bool = False) -> DataFrame:
    """Files whose (processor, path, size, mtime), or with ``by_content``
    (processor, path, sha1), are not in the manifest."""
    if force or manifest is None:
        return listing
    keys = ["processor", "path", "sha1"] if by_content else ["processor", "path", "size_bytes", "mtime"]
    return listing.join(manifest.select(*keys), keys, "left_anti")


def file_bucket(file_col: str = "_file"):
    return F.pmod(F.xxhash64(file_col), F.lit(BUCKETS)).cast("int")


def write_table(df: DataFrame, path: str, files: DataFrame, overwrite_all: bool) -> None:
    """K1: ``df`` are the new rows of ``files`` (column ``path``). With
    ``overwrite_all`` they become the table; else they replace what the table
    has of these files. REBALANCE lets AQE split a hot bucket into several
    writers."""
    spark = df.sparkSession
    new = df.withColumn("_bucket", file_bucket())
    old = None if overwrite_all else read_parquet(spark, path)
    if old is None:
        (new.hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "static")
            .partitionBy("_bucket").parquet(path))
        return
    touched = [r[0] for r in files.select(file_bucket("path").alias("b")).distinct().collect()]  # at most BUCKETS
    rest = old.where(F.col("_bucket").isin(touched)).join(files.select(F.col("path").alias("_file")), "_file", "left_anti")
    merged = staged(rest.unionByName(new, allowMissingColumns=True), "merge")
    (merged.hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("_bucket").parquet(path))
    filled = {r[0] for r in merged.select("_bucket").distinct().collect()}
    for b in set(touched) - filled:  # no row is left there, so the write above did not replace the folder
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_path(path, f"_bucket={b}"))
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    spark.catalog.refreshByPath(path)


def run_etl(spark: SparkSession, input_dir: str, output_dir: str, *, incremental: bool = True,
            force: bool = False, include: set[str] | None = None, exclude: set[str] | None = None,
            max_files: int | None = None, strict_json: bool = False,
            schemas: dict[str, object] | None = None, by_content: bool = False) -> EtlResult:
    """Run the processors; returns run id, processed-file counts and table paths.

    ``incremental=False`` is a full rebuild: every table of the processors that
    run is overwritten, also by nothing. Strict mode fails the run on the first
    unparseable file. ``by_content`` compares files by sha1 instead of size and
    mtime.
    """
    checkpoint_dir(spark)
    run_id = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    result = EtlResult(run_id)
    manifest = read_manifest(spark, output_dir) if incremental else None
    done: list[_Done] = []
    for proc in json_files.PROCESSORS:
        if (include and proc not in include) or (exclude and proc in exclude):
            continue
        listing = json_files.list_files(spark, input_dir, proc, max_files, by_content)
        listing = staged(listing if by_content else listing.withColumn("sha1", F.lit(None).cast("string")), f"listing-{proc}")
        todo = staged(changed_files(listing, manifest, force, by_content), f"todo-{proc}")
        d = _Done(proc, listing, todo, _quarantine(spark, [(proc, p, "empty file") for p in json_files.empty_files(spark, input_dir, proc)]))
        done.append(d)
        _run_processor(spark, output_dir, result, d, strict_json, (schemas or {}).get(proc), incremental)
    if done:
        q = _union([d.quarantine for d in done])
        q.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(_path(output_dir, "_quarantine"))
    _rebuild_dims(spark, output_dir, {t: (_path(output_dir, t), d.todo) for d in done for t in d.tables}, incremental)
    for d in done:
        _record_manifest(d.todo, d.quarantine, output_dir, run_id)
    _write_quality(spark, output_dir, run_id, done)
    return result


@dataclass
class _Done:
    proc: str
    listing: DataFrame
    todo: DataFrame
    quarantine: DataFrame
    tables: list[str] = field(default_factory=list)


def _quarantine(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "processor string, path string, reason string")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _tables_for(proc: str, records: DataFrame) -> dict[str, DataFrame]:
    if proc == "events":
        return {"events": ingest.events_table(records)}
    if proc == "competitions":
        return {"competitions": ingest.competitions_table(records)}
    if proc == "matches":
        return {"matches": ingest.matches_table(records)}
    if proc == "lineups":
        return {"lineups_players": ingest.lineups_table(records), "lineup_entries": ingest.lineup_entries(records)}
    main, ff, vis = ingest.three_sixty_tables(records)
    return {"three_sixty": main, "three_sixty_freeze_frames": ff, "three_sixty_visible_area": vis}


def _run_processor(spark: SparkSession, output_dir: str, result: EtlResult, d: _Done, strict_json: bool,
                   schema, incremental: bool) -> None:
    """The changed files of one processor. Their elements are staged once and
    read by each table's write, so nothing is held in memory."""
    n = d.todo.count()
    result.processed_files[d.proc] = n
    if strict_json and (first := d.quarantine.first()):
        raise ValueError(f"Failed to parse JSON: {first['path']}")
    if not n:
        if not incremental:
            for name in PROCESSOR_TABLES[d.proc]:
                _truncate(spark, _path(output_dir, name))
        return
    groups = file_groups(n)
    for g in range(groups):
        todo = d.todo.where(F.floor(file_bucket("path") * groups / BUCKETS) == g) if groups > 1 else d.todo
        _read_group(spark, output_dir, result, d, todo, strict_json, schema, overwrite_all=not incremental and g == 0)


def file_groups(n: int) -> int:
    """Reads that ``n`` files take. Each has buckets of its own, so that no read rewrites the rows of another."""
    return min(BUCKETS, -(-n // FILES_A_READ))


def _read_group(spark: SparkSession, output_dir: str, result: EtlResult, d: _Done, todo: DataFrame, strict_json: bool, schema,
                overwrite_all: bool) -> None:
    """The files ``todo`` of a processor: read, quarantined where broken, their rows replaced in its tables."""
    paths = [r["path"] for r in todo.select("path").orderBy("path").collect()]  # FILES_A_READ or so names, as Spark's reader takes them
    if not paths:
        if overwrite_all:
            for name in PROCESSOR_TABLES[d.proc]:
                _truncate(spark, _path(output_dir, name))
        return
    records, quarantine = json_files.read_records(spark, paths, schema, d.proc)
    quarantine = staged(quarantine, f"quarantine-{d.proc}")
    if strict_json and (first := quarantine.first()):
        raise ValueError(f"Failed to parse JSON: {first['path']}")
    d.quarantine = d.quarantine.unionByName(quarantine)
    good = staged(todo.join(quarantine.select("path"), "path", "left_anti"), f"good-{d.proc}")
    if records.isEmpty():
        for name in PROCESSOR_TABLES[d.proc]:
            path = _path(output_dir, name)
            if overwrite_all:
                _truncate(spark, path)
            elif (old := read_parquet(spark, path)) is not None:  # the changed files hold no records any more
                write_table(old.where(F.lit(False)).drop("_bucket"), path, good, False)
        return
    for name, df in _tables_for(d.proc, records).items():
        path = _path(output_dir, name)
        write_table(ingest.stored(df, name), path, good, overwrite_all=overwrite_all)
        result.tables[name] = path
        if name not in d.tables:
            d.tables.append(name)


def _truncate(spark: SparkSession, path: str) -> None:
    """A full rebuild that found nothing leaves an empty table, not the old one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _record_manifest(todo: DataFrame, quarantine: DataFrame, output_dir: str, run_id: str) -> None:
    """Remember the files that made it, after tables and dims are committed;
    quarantined files are left out so the next run retries them."""
    ok = todo.join(quarantine.select("path"), "path", "left_anti")
    (ok.select("processor", "path", "size_bytes", "mtime", "sha1",
               F.current_timestamp().alias("recorded_at"), F.lit(run_id).alias("run_id"))
       .write.mode("append").parquet(_path(output_dir, "_manifest")))


def _rebuild_dims(spark: SparkSession, output_dir: str, produced: dict[str, tuple[str, DataFrame]], incremental: bool) -> None:
    """Previous dims < changed events < matches < lineups; freeze-frame
    players only if absent. Checkpointed before overwriting the same path."""
    teams_p, players_p = _path(output_dir, "teams"), _path(output_dir, "players")
    prev_t = read_parquet(spark, teams_p) if incremental else None
    prev_p = read_parquet(spark, players_p) if incremental else None

    def changed_rows(name: str) -> DataFrame | None:
        """Rows of this run's files, read back from the written table."""
        if name not in produced:
            return None
        path, files = produced[name]
        rows = read_parquet(spark, path)
        return None if rows is None else rows.join(files.select(F.col("path").alias("_file")), "_file", "left_semi")

    ev = changed_rows("events")
    if ev is not None:
        ev = ev.select("team_id", "team_name" if "team_name" in ev.columns else F.lit("").alias("team_name"),
                       "player_id", "player_name" if "player_name" in ev.columns else F.lit("").alias("player_name"),
                       "_file", "_pos", "_rank")
    teams, players = ingest.etl_dimensions(ev, changed_rows("matches"), changed_rows("lineups_players"),
                                           changed_rows("three_sixty_freeze_frames"), prev_t, prev_p,
                                           changed_rows("lineup_entries"))
    for df, path in ((teams, teams_p), (players, players_p)):
        if df is None:
            continue
        # lineage cut: the new dim may read the old one at the same path
        df.checkpoint(eager=True).write.mode("overwrite").parquet(path)


def _write_quality(spark: SparkSession, output_dir: str, run_id: str, done: list[_Done]) -> None:
    if not done:
        return
    qdir = _path(output_dir, "_quality")
    empty = _union([d.quarantine.where("reason = 'empty file'") for d in done])
    # 0-byte files are found, read and failed like any other broken file
    as_files = empty.select("processor", "path", F.lit(0).cast("bigint").alias("size_bytes"), F.lit(0).cast("bigint").alias("mtime"), F.lit(None).cast("string").alias("sha1"))
    quality.file_summary(_union([d.listing for d in done]).unionByName(as_files), _union([d.todo for d in done]).unionByName(as_files),
                         _union([d.quarantine for d in done])).withColumn("run_id", F.lit(run_id)) \
        .write.mode("append").parquet(_path(qdir, "files"))
    tables = {}
    for name in [t for ts in PROCESSOR_TABLES.values() for t in ts if t != "lineup_entries"] + ["teams", "players"]:
        if (df := read_parquet(spark, _path(output_dir, name))) is not None:
            tables[name] = df
    if not tables:
        return
    quality.row_counts(tables).withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(_path(qdir, "rows"))
    quality.required_columns_check(spark, tables, ingest.REQUIRED_COLUMNS).withColumn("run_id", F.lit(run_id)) \
        .write.mode("append").parquet(_path(qdir, "required"))
    rates = [quality.key_null_rates(df, name, ingest.KEY_NULL_COLUMNS.get(name, [])) for name, df in tables.items()
             if ingest.KEY_NULL_COLUMNS.get(name)]
    if rates:
        _union(rates).withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(_path(qdir, "null_rates"))


def quality_report_markdown(spark: SparkSession, output_dir: str, run_id: str | None = None) -> str:
    """K5: markdown over the (small) quality tables of one run."""
    qdir = _path(output_dir, "_quality")
    parts = ["# Data Quality Report", ""]
    for name, title in (("files", "Files"), ("rows", "Row counts"), ("null_rates", "Key null rates")):
        p = _path(qdir, name)
        if (df := read_parquet(spark, p)) is None:
            continue
        if run_id is None:
            run_id = df.agg(F.max("run_id")).first()[0]
        rows = df.where(F.col("run_id") == run_id).drop("run_id").orderBy(*df.drop("run_id").columns[:2]).collect()
        parts += [f"## {title}", ""]
        for r in rows:
            parts.append("- " + ", ".join(f"{k}: {v}" for k, v in r.asDict().items()))
        parts.append("")
    return "\n".join(parts)
