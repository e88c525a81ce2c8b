"""Flatten nested records into one column per leaf (``a.b`` -> ``a_b``).

The walk runs over the *schema* on the driver and emits one select list, so
the flattening itself is a projection inside whole-stage codegen. Lists
become JSON text; numeric lists under a coordinate key also get ``_x``,
``_y`` (and ``_z``) columns when they hold 2 or 3 numbers.

Deviation: Spark's ``to_json`` writes ``[1.0,2.0]`` (no spaces) where
Python writes ``[1.0, 2.0]``; compare parsed values, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys whose numeric lists are coordinates.
COORDINATE_KEYS = ("location", "pass_end_location", "carry_end_location", "shot_end_location")
_AXES = ("x", "y", "z")
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _is_coordinate_key(name: str) -> bool:
    return name in COORDINATE_KEYS or name.endswith("_location")


def flatten_columns(schema: T.StructType, prefix: str = "", path: Column | None = None) -> list[Column]:
    """Select list that flattens ``schema`` (columns named ``parent_child``)."""
    out: list[Column] = []
    for field in schema.fields:
        name = f"{prefix}_{field.name}" if prefix else field.name
        col = path.getField(field.name) if path is not None else F.col(f"`{field.name}`")
        dt = field.dataType
        if isinstance(dt, T.StructType):
            out.extend(flatten_columns(dt, name, col))
        elif isinstance(dt, T.ArrayType):
            out.append(F.to_json(col).alias(name))
            if isinstance(dt.elementType, _NUMERIC) and _is_coordinate_key(name):
                n = F.size(col)
                for i, axis in enumerate(_AXES):
                    out.append(F.when(n.isin(2, 3), F.get(col, i).cast("double")).alias(f"{name}_{axis}"))
        elif isinstance(dt, T.MapType):
            out.append(F.to_json(col).alias(name))
        else:
            out.append(col.alias(name))
    return out


def flatten(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Flatten every nested column of ``df``; ``keep`` columns pass through."""
    keep = keep or []
    rest = T.StructType([f for f in df.schema.fields if f.name not in keep])
    return df.select(*[F.col(c) for c in keep], *flatten_columns(rest))


def flatten_json_column(df: DataFrame, column: str, schema: T.StructType | str | None = None,
                        keep: list[str] | None = None) -> DataFrame:
    """Parse a JSON text column and flatten it under ``column_`` names.

    Without a schema one is inferred from the data (a Spark JSON scan of the
    column), as the source infers per run; production runs pass a declared
    schema.
    """
    if schema is None:
        spark = df.sparkSession
        schema = spark.read.json(df.select(column).where(F.col(column).isNotNull()).rdd.map(lambda r: r[0])).schema
    parsed = df.withColumn("_parsed", F.from_json(F.col(column), schema))
    keep = keep if keep is not None else [c for c in df.columns if c != column]
    struct_t = parsed.schema["_parsed"].dataType
    return parsed.select(*[F.col(c) for c in keep], *flatten_columns(struct_t, column, F.col("_parsed")))
