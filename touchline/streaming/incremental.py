"""Continuous arrival of match files with Structured Streaming.

A file-source stream over the input folder (``wholetext``: one row per file) feeds
``foreachBatch``. The files of each micro-batch are told apart by their folder; each
processor's files are parsed like in the batch ETL and replace their own rows
(``etl.write_table``), so a batch replayed after an executor or driver failure
leaves the same tables. Quarantine rows and the state of the teams and players lie
in folders of their batch, which a replay overwrites. The checkpoint location is an
argument; without it, it lies under the shared ``spark.checkpoint.dir``.
``trigger(availableNow=True)`` processes what is there and stops, the streaming
equivalent of one incremental run.

Teams and players are kept with the place of the row that names them (``ingest.dim_candidates``).
A batch adds its rows' places to the state of the batch before and keeps the greatest
a key, so the dims after any order of batches, and any replay of the last one, are those of
one batch run over all files.

The file source never re-reads a file whose content changed in place, and does not see
empty files; the manifest-based batch ETL (I1) remains the way to pick up edited files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from touchline.operators import ingest
from touchline.plans import etl
from touchline.session import checkpoint_dir, staged
from touchline.sources import json_files
from touchline.sources.tables import read_parquet

#: Table of each dimension's state: key and the columns beside the place.
STATE = {"teams": "team_id bigint, team_name string", "players": "player_id bigint, player_name string, team_id bigint"}
_PLACE = "o struct<r: int, f: string, p: bigint, s: bigint>"


def processor_of(file: Column, root: str) -> Column:
    """Processor of a file by its place below the input folder; null if none takes it."""
    inside = F.regexp_extract(file, "^(?:file:)?/*" + _literal(root.rstrip("/").removeprefix("file:").lstrip("/")) + "/(.*)$", 1)
    out = F.when(inside.rlike(r"^events/[^/]+\.json$"), "events").when((inside == "competitions.json") | inside.startswith("competitions/"), "competitions")
    for p in ("matches", "lineups", "three-sixty"):
        out = out.when(inside.startswith(p + "/"), p)
    return out


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def apply_batch(batch: DataFrame, batch_id: int, output_dir: str, processor: Column, schemas: dict[str, T.StructType] | None = None,
                label: str = "files") -> None:
    """Puts the files of ``batch`` (``_file, value``) into the processed tables and dims below ``output_dir``.

    ``schemas``: record schemas by processor; what is not given is merged from the batch.
    """
    spark = batch.sparkSession
    out = output_dir.rstrip("/")
    rows = staged(batch.select("_file", "value", processor.alias("_proc")), "stream-batch")
    tables: dict[str, DataFrame] = {}
    quarantined = None
    for proc in json_files.PROCESSORS:
        mine = rows.where(F.col("_proc") == proc).select("_file", "value")
        if mine.isEmpty():
            continue
        found, broken = json_files.elements(mine, proc)
        found, broken = staged(found, f"stream-{proc}"), staged(broken, f"stream-broken-{proc}")
        quarantined = broken if quarantined is None else quarantined.unionByName(broken)
        files = staged(mine.select(F.col("_file").alias("path")).join(broken.select("path"), "path", "left_anti"), "stream-files")
        if found.isEmpty():
            continue
        records = json_files.as_records(found, (schemas or {}).get(proc) or json_files.record_schema(found, proc), proc)
        for name, df in etl._tables_for(proc, records).items():
            tables[name] = ingest.stored(df, name)
            etl.write_table(tables[name], f"{out}/{name}", files, overwrite_all=False)
    if quarantined is not None:
        quarantined.write.mode("overwrite").parquet(f"{out}/_quarantine/run_id=stream-{label}-{batch_id}")
    _advance_dims(spark, out, batch_id, label, tables)


def _advance_dims(spark: SparkSession, out: str, batch_id: int, label: str, tables: dict[str, DataFrame]) -> None:
    found = ingest.dim_candidates(tables.get("events"), tables.get("matches"), tables.get("lineups_players"), tables.get("three_sixty_freeze_frames"),
                                  entries=tables.get("lineup_entries"))
    for (name, columns), rows in zip(STATE.items(), found, strict=True):
        key = columns.split()[0]
        base = f"{out}/_state/{label}/{name}"
        before = read_parquet(spark, base)  # partitioned by batch; a replay must not see itself
        if before is not None:
            last = before.where(F.col("batch") < batch_id).agg(F.max("batch")).first()[0]
            before = None if last is None else before.where(F.col("batch") == last).drop("batch")
        merged = rows
        if before is not None:
            before = before.select(*T._parse_datatype_string(f"{columns}, {_PLACE}").names)
            merged = before if rows is None else rows.unionByName(before)
        if merged is None:
            continue
        state = f"{base}/batch={batch_id}"
        ingest.last_named(merged, key).write.mode("overwrite").parquet(state)
        spark.read.schema(f"{columns}, {_PLACE}").parquet(state).drop("o").write.mode("overwrite").parquet(f"{out}/{name}")


def stream_files(spark: SparkSession, input_dir: str, output_dir: str, schemas: dict[str, T.StructType] | None = None,
                 query_name: str = "touchline_files", available_now: bool = True, max_files_per_trigger: int = 1000,
                 checkpoint: str | None = None) -> StreamingQuery:
    """Streams the files of all five processors below ``input_dir``; returns the running query."""
    raw = _whole_files(spark, input_dir, max_files_per_trigger)
    return _start(raw, query_name, available_now, checkpoint,
                  lambda batch, batch_id: apply_batch(batch, batch_id, output_dir, processor_of(F.col("_file"), input_dir), schemas, query_name))


def stream_events(spark: SparkSession, events_dir: str, output_dir: str, schema: T.StructType,
                  query_name: str = "touchline_events", available_now: bool = True,
                  max_files_per_trigger: int = 1000, checkpoint: str | None = None) -> StreamingQuery:
    """Streams a folder of event files alone."""
    raw = _whole_files(spark, events_dir, max_files_per_trigger)
    return _start(raw, query_name, available_now, checkpoint,
                  lambda batch, batch_id: apply_batch(batch, batch_id, output_dir, F.lit("events"), {"events": schema}, query_name))


def _whole_files(spark: SparkSession, folder: str, max_files: int) -> DataFrame:
    return (spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
            .option("maxFilesPerTrigger", max_files).load(folder).select(F.col("_metadata.file_path").alias("_file"), "value"))


def _start(raw: DataFrame, query_name: str, available_now: bool, checkpoint: str | None, write_batch) -> StreamingQuery:
    ckpt = checkpoint or f"{checkpoint_dir(raw.sparkSession).rstrip('/')}/streams/{query_name}"
    writer = raw.writeStream.queryName(query_name).option("checkpointLocation", ckpt).foreachBatch(write_batch)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
