"""Raw JSON match files: listing (S2), reading with positions (S1, S3),
quarantine of unparseable files (K4).

Each file is read whole (``wholetext``), so one file is one row and one task
unit, the same parallelism as a multi-line JSON read. A file of any size is parsed
strictly as a whole and cut into its elements, each a value of its own (Spark's limit
of 128 MiB a variant is one of an element); every object of a list is a
record, other elements are dropped, and a file with one object counts as a
list of one. ``posexplode`` keeps each record's position in its file:
"first/last row wins" rules then have a total, shuffle-proof order
``(processor rank, file path, position)``. Elements are staged once; the
record schema (declared, or merged from all elements) is applied to them.

Spark file sources do not list 0-byte files; :func:`empty_files` finds them
through the Hadoop file system.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import staged

# Processor names and their rank in "last seen wins" order.
PROCESSORS = ("events", "competitions", "matches", "lineups", "three-sixty")
PROCESSOR_RANK = {p: i for i, p in enumerate(PROCESSORS)}
_BOM = "\ufeff"


def _join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *[p.strip("/") for p in parts]])


def list_files(spark: SparkSession, root: str, processor: str, max_files: int | None = None, by_content: bool = False) -> DataFrame:
    """(processor, path, size_bytes, mtime) for the processor's JSON files, and with ``by_content`` their ``sha1``.

    events: ``events/*.json`` if that folder exists, else ``*.json`` at the
    root (not recursive); competitions: ``competitions.json`` plus everything
    under ``competitions/``; others: recursive under their folder. Sorted by
    path; ``max_files`` applies to the sorted listing.
    """
    def listing(path: str, recursive: bool, glob: str = "*.json") -> DataFrame | None:
        reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
        if recursive:
            reader = reader.option("recursiveFileLookup", "true")
        try:
            df = reader.load(path)
        except Exception as exc:  # path missing -> no files
            if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
                return None
            raise
        return df.select("path", F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("mtime"),
                         *[F.sha1("content").alias("sha1")] * by_content)

    if processor == "events":
        frames = [listing(_join(root, "events"), False)]
        if frames[0] is None:
            frames = [listing(root, False)]
    elif processor == "competitions":
        frames = [listing(root, False, "competitions.json"), listing(_join(root, "competitions"), True)]
    else:
        frames = [listing(_join(root, processor), True)]
    frames = [f for f in frames if f is not None]
    if not frames:
        return spark.createDataFrame([], "processor string, path string, size_bytes bigint, mtime bigint" + ", sha1 string" * by_content)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    out = out.dropDuplicates(["path"]).select(F.lit(processor).alias("processor"), "*")
    if max_files is not None and max_files > 0:
        out = out.orderBy("path").limit(max_files)
    return out


def match_id_from_path(path: Column) -> Column:
    """S3: integer match id from the file stem; null when the stem is not an int."""
    stem = F.regexp_extract(path, r"([^/]+)\.json$", 1)
    return F.when(stem.rlike(r"^[+-]?\d+$"), stem.try_cast("bigint"))


def empty_files(spark: SparkSession, root: str, processor: str) -> list[str]:
    """Paths of the processor's 0-byte JSON files (K4), from the Hadoop listing."""
    jvm = spark.sparkContext._jvm

    def listed(path: str, recursive: bool, name: str | None = None) -> list[str]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        out, files = [], fs.listFiles(p, recursive)
        while files.hasNext():
            f = files.next()
            own = f.getPath().getName()
            if f.getLen() == 0 and own.endswith(".json") and not own.startswith(("_", ".")) and name in (None, own):
                out.append(f.getPath().toString())
        return out

    if processor == "events":
        p = jvm.org.apache.hadoop.fs.Path(_join(root, "events"))
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return sorted(listed(_join(root, "events") if there else root, False))
    if processor == "competitions":
        return sorted(listed(root, False, "competitions.json") + listed(_join(root, "competitions"), True))
    return sorted(listed(_join(root, processor), True))


def once(value: Column) -> Column:
    """``value``, computed once a row: filters and projections that use it do not repeat its expression.

    A filter on a projected column is moved below the projection with the expression in the
    column's place, so a document was written and parsed anew for each test of it. Nothing
    moves a generator's output.
    """
    return F.explode(F.array(value))


def elements(raw: DataFrame, processor: str = "events") -> tuple[DataFrame, DataFrame]:
    """``(_file, value)`` rows holding whole files -> ``(_file, _pos, _json)``, one row
    per object, and the quarantine ``(processor, path, reason)``.

    Strict: a file that is not one JSON value, that goes on after it, or whose value is
    neither a list nor an object, is quarantined whole. List items that are no objects are
    dropped; positions count all items.
    """
    parsed = raw.select("_file", once(F.btrim("value", F.lit(" \t\r\n" + _BOM))).alias("_text"))
    is_list, is_object = F.col("_text").startswith("["), F.col("_text").startswith("{")
    # a value that ends before the text does is one still when the text's last character is gone
    less = F.expr("substr(_text, 1, length(_text) - 1)")
    list_ends, object_ends = F.json_array_length(less).isNull(), F.json_object_keys(less).isNull()
    items, item = F.from_json("_text", "array<variant>"), F.expr("from_json(_text, 'variant')")
    ok = F.when(is_list, list_ends & items.isNotNull()).when(is_object, object_ends & item.isNotNull()).otherwise(False)
    quarantine = parsed.select("_file", once(ok).alias("_ok")).where("not _ok").select(
        F.lit(processor).alias("processor"), F.col("_file").alias("path"), F.lit("unparseable JSON").alias("reason"))
    found = (parsed.select("_file", F.posexplode(F.when(is_list & list_ends, items).when(is_object & object_ends, F.array(item))).alias("_pos", "_item"))
             .select("_file", "_pos", once(F.to_json("_item")).alias("_json")).where(F.col("_json").startswith("{")))
    return found, quarantine


def schema_of(found: DataFrame) -> T.StructType:
    """Union schema of the objects in ``_json``: a type that differs between records, or is
    always null, is text; decimals are doubles."""
    ddl = found.agg(F.expr("schema_of_variant_agg(parse_json(_json))")).first()[0]
    if not ddl or not ddl.startswith("OBJECT<"):
        return T.StructType([])
    ddl = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", ddl.replace("OBJECT<>", "STRING").replace("OBJECT<", "STRUCT<"))
    return T._parse_datatype_string(re.sub(r"(?<=[:<] )(VARIANT|VOID)(?=[,>])|(?<=<)(VARIANT|VOID)(?=>)", "STRING", ddl))


#: Declared types, the same in every run: whole records of lineups, the nested lists of three-sixty.
LINEUP_RECORD = ("team_id string, team_name string, team struct<id: string, name: string>, lineup array<struct<"
                 "player_id: string, player_name: string, jersey_number: string, positions: array<struct<"
                 "position_id: string, position: string, `from`: string, `to`: string, start_reason: string>>>>")
THREE_SIXTY_LISTS = ("visible_area array<double>, freeze_frame array<struct<"
                     "player_id: string, teammate: boolean, actor: boolean, keeper: boolean, location: array<double>>>")


def record_schema(found: DataFrame, processor: str) -> T.StructType:
    """Schema of a processor's records: declared where their shape is known, else merged from the data."""
    if processor == "lineups":
        return T._parse_datatype_string(LINEUP_RECORD)
    inferred = schema_of(found)
    if processor == "three-sixty":
        declared = T._parse_datatype_string(THREE_SIXTY_LISTS)
        return T.StructType([f for f in inferred.fields if f.name not in declared.names] + declared.fields)
    return inferred


def infer_record_schema(spark: SparkSession, paths: list[str], processor: str = "events") -> T.StructType:
    """Schema of the records in ``paths``."""
    return record_schema(elements(read_raw(spark, paths), processor)[0], processor)


def read_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("wholetext", "true").text(paths).select(F.col("_metadata.file_path").alias("_file"), "value")


def as_records(found: DataFrame, schema: T.StructType, processor: str) -> DataFrame:
    """Elements as rows of the schema's columns plus ``_file``, ``_pos`` and ``_rank``."""
    return (found.select("_file", "_pos", once(F.from_json("_json", schema)).alias("_rec"))
            .select("_rec.*", "_file", "_pos", F.lit(PROCESSOR_RANK.get(processor, 99)).alias("_rank")))


def read_records(spark: SparkSession, paths: list[str], schema: T.StructType | None = None,
                 processor: str = "events") -> tuple[DataFrame, DataFrame]:
    """Records of the files, one row per object, plus a quarantine frame.

    Returns ``(records, quarantine)``. ``records`` has the record's columns plus
    ``_file`` (path), ``_pos`` (position in the file) and ``_rank`` (processor
    rank). ``quarantine`` has ``(processor, path, reason)`` for files that do
    not parse.
    """
    found, quarantine = elements(read_raw(spark, paths), processor)
    found = staged(found, f"json-{processor}")
    return as_records(found, schema if schema is not None else record_schema(found, processor), processor), quarantine


def parse_whole_files(raw: DataFrame, schema: T.StructType, processor: str = "events") -> tuple[DataFrame, DataFrame]:
    """Parse ``(_file, value)`` rows holding whole JSON files (batch or a
    streaming micro-batch) into ``(records, quarantine)``."""
    found, quarantine = elements(raw, processor)
    return as_records(found, schema, processor), quarantine


def ingest_order() -> Column:
    """Total ingestion order: (processor rank, file path, position in file)."""
    return F.struct(F.col("_rank"), F.col("_file"), F.col("_pos"))
