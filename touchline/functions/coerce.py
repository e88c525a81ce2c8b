"""Tolerant coercions (text or typed input) as Spark column expressions.

ANSI mode is on in Spark 4, so a plain ``cast('abc' as double)`` raises;
everything here goes through ``try_cast``. Helpers that need the input type
take the DataFrame so typed columns skip the text round trip and keep
Parquet predicate pushdown intact.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def text_to_double(c: Column) -> Column:
    """'  1.5 ' -> 1.5, '' / 'abc' -> null, 'nan' -> null."""
    return _nan_to_null(F.trim(c.cast("string")).try_cast("double"))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# The per-column coercions are written as one SQL expression each: the same
# Catalyst expressions as the nested Column calls, built in one step.

def _double_sql(df: DataFrame, name: str) -> str:
    dt = _dtype(df, name)
    src = (f"cast({_q(name)} as double)" if isinstance(dt, _NUMERIC)
           else f"try_cast(trim(cast({_q(name)} as string)) as double)")
    return f"nanvl({src}, cast(null as double))"


def double_col(df: DataFrame, name: str) -> Column:
    """Column ``name`` as DOUBLE; NaN and unparseable text become null."""
    return F.expr(_double_sql(df, name))


def _bigint_sql(df: DataFrame, name: str) -> str:
    if isinstance(_dtype(df, name), _INTEGRAL):
        return f"cast({_q(name)} as bigint)"
    return f"try_cast({_double_sql(df, name)} as bigint)"


def bigint_col(df: DataFrame, name: str) -> Column:
    """Column ``name`` as BIGINT, truncating toward zero like ``int(float(text))``.

    '12.7' -> 12, '-3.9' -> -3, ' 5 ' -> 5, '' / 'abc' / 'nan' / 'inf' -> null.
    """
    return F.expr(_bigint_sql(df, name))


def int_col(df: DataFrame, name: str) -> Column:
    return F.expr(f"try_cast({_bigint_sql(df, name)} as int)")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, '' -> null."""
    t = F.trim(c.cast("string"))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def nested_to_null(c: Column) -> Column:
    """Text that looks like a JSON list/object becomes null (facts keep scalars only)."""
    t = c.cast("string")
    return F.when(F.coalesce(F.trim(t).rlike(r"^[\[{]"), F.lit(False)), F.lit(None).cast("string")).otherwise(t)


def label_or_null(c: Column) -> Column:
    """Trimmed label; numeric-looking text (e.g. '97') counts as missing."""
    t = F.trim(c.cast("string"))
    return F.when(t.try_cast("double").isNull(), t)


def bool_col(df: DataFrame, name: str) -> Column:
    """'1/0/true/false/t/f/yes/no' and booleans -> BOOLEAN; anything else null."""
    dt = _dtype(df, name)
    if isinstance(dt, T.BooleanType):
        return F.col(name)
    if isinstance(dt, _NUMERIC):
        return F.col(name) != 0
    t = F.lower(F.trim(F.col(name).cast("string")))
    return (F.when(t.isin("1", "true", "t", "yes", "y", "1.0"), F.lit(True))
            .when(t.isin("0", "false", "f", "no", "n", "0.0"), F.lit(False)))


def existing(df: DataFrame, candidates: Iterable[str]) -> list[str]:
    cols = set(df.columns)
    return [c for c in candidates if c in cols]


def coalesce_existing(df: DataFrame, candidates: Iterable[str], default=None) -> Column:
    """``coalesce`` over the candidate columns present in ``df`` (absent ones skipped)."""
    present = [F.col(c) for c in existing(df, candidates)]
    if default is not None:
        present.append(F.lit(default))
    if not present:
        return F.lit(None)
    return present[0] if len(present) == 1 else F.coalesce(*present)


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """The column if present, else a typed null (tolerant projection)."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def not_true(c: Column) -> Column:
    """pandas-style negation: null counts as 'not equal' -> True."""
    return ~F.coalesce(c, F.lit(False))


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def norm_text(c: Column) -> Column:
    """trim + lower, used for label comparisons."""
    return F.lower(F.trim(c.cast("string")))
