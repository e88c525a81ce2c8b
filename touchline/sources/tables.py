"""Table resolution and tolerant reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables the report pages need.
REQUIRED_MODEL_TABLES = ("dim_match", "dim_team", "dim_player", "fact_events", "fact_shots")


def read_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table whose files may carry different columns; None only if there is no such path."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("header", "true").csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_table(spark: SparkSession, base_dir: str, name: str, schema: T.StructType | str | None = None
               ) -> DataFrame | None:
    """``<dir>/<name>`` as Parquet (folder or ``.parquet``), else CSV with
    a header (``<name>.csv``, or a folder ``<name>`` with ``.csv`` files); None
    when missing, any other failure is raised. With ``schema`` a missing table
    is an empty DataFrame of that schema (S4)."""
    base = base_dir.rstrip("/")
    for path in (f"{base}/{name}", f"{base}/{name}.parquet"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if path.endswith(name) and _has_csv(files, path):
            return _read_csv(spark, path)
        if (df := read_parquet(spark, path)) is not None and df.columns:
            return df
    if (df := _read_csv(spark, f"{base}/{name}.csv")) is not None and df.columns:
        return df
    return spark.createDataFrame([], schema) if schema is not None else None


def _has_csv(reader, path: str) -> bool:
    """Whether a folder holds CSV files (a listing, no content is read)."""
    try:
        return not reader.option("pathGlobFilter", "*.csv").load(path).select("path").isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def missing_required_tables(spark: SparkSession, base_dir: str,
                            required: tuple[str, ...] = REQUIRED_MODEL_TABLES) -> list[str]:
    """Required tables that cannot be resolved."""
    return [t for t in required if read_table(spark, base_dir, t) is None]


def read_order(df: DataFrame) -> Column | None:
    """Where a row stands in a Parquet table: its file and its number there; None if ``df`` does not
    come straight from such files. Files are taken by path, so the order is the same in every run."""
    if "_metadata" not in df._jdf.queryExecution().analyzed().metadataOutput().mkString(","):
        return None
    try:
        df.select("_metadata.row_index")
    except AnalysisException:  # text files have no row numbers
        return None
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def project_existing(df: DataFrame, columns) -> DataFrame:
    """Requested columns that exist (Catalyst prunes the scan to them)."""
    cols = set(df.columns)
    return df.select(*[c for c in columns if c in cols])


def schema_probe(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types without reading data."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def preview(df: DataFrame, n: int = 200) -> tuple[int, int, DataFrame]:
    """(row count, column count, first ``n`` rows)."""
    return df.count(), len(df.columns), df.limit(n)
