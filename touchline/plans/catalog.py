"""Registered driver queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (the
pitch projection of ``events`` for event operators, the TPC-H-like tables
for table-agnostic ones). ``ORACLE[name]`` is the same result written as
plain SQL for DuckDB over the same tables. Output columns are aliased
identically on both sides; doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.sources.fixtures import oracle, pitch_dims, pitch_events

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (result hygiene for cross-engine compare)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# Load the query modules so their @register decorators run.
from touchline.plans import queries_events  # noqa: E402,F401
from touchline.plans import queries_model  # noqa: E402,F401
from touchline.plans import queries_raw  # noqa: E402,F401
from touchline.plans import queries_reports  # noqa: E402,F401
from touchline.plans import queries_tables  # noqa: E402,F401

__all__ = ["QUERIES", "ORACLE", "register", "round_doubles", "oracle", "pitch_dims", "pitch_events"]
