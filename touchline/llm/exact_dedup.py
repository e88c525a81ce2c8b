"""Exact dedup: rows grouped by a 128-bit hash of their text, byte comparison inside
groups, one row of each group of equal texts stays.

DataFrame functions only. Texts are hashed where they are read; what is grouped and
joined are narrow rows of hashes and ids. Whole texts are shuffled only for rows
whose hash occurs more than once, already combined map-side to one text a task, to
prove that all texts of a hash are the same bytes.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import NULL_ID, prefiltered, staged

#: A group with more than one HOT-th of all rows is joined by broadcast; there are fewer than HOT such groups.
HOT = 1000


def fold_ascii(text: Column) -> Column:
    """The text that is compared: null as empty, A to Z in lower case, nothing else changed."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def _decide(rows: DataFrame, keys: list[str], largest: bool) -> DataFrame:
    """``rows`` (keys, ``_id``, ``_tie``, ``_row`` and others), each with ``_n`` rows of its keys and their ``_first``.

    Groups are combined map-side. Those with over a thousandth of all rows, fewer
    than a thousand, are broadcast, so that no task gets a hot group's rows; the
    others are joined by shuffle. Rows that are alone take part in no join result.
    """
    pick = F.max if largest else F.min
    groups = staged(rows.groupBy(*keys).agg(F.count("*").alias("_n"), pick(F.struct("_id", "_tie", "_row")).alias("_o")).where("_n > 1")
                    .select(*keys, "_n", F.col("_o._id").alias("_keep"), F.col("_o._row").alias("_first")), "exact-groups")
    total = rows.count()
    hot = F.broadcast(groups.where(F.col("_n") * HOT > total))
    cold = groups.where(F.col("_n") * HOT <= total)
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(cold, keys, "left"))


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] | None = None, keep: str = "smallest",
           normalise: Callable[[Column], Column] = fold_ascii, content: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Each row of ``docs`` (its ``columns``; the id alone if None) with ``dup_keep_id`` (id of the row of its
    group that stays), ``dup_size`` (rows of the group), ``dup_kept`` and ``dup_sha256`` (of the compared text).

    The row with the smallest (or ``keep="largest"``) id stays; rows with one id are told
    apart by a hash of their raw text, and of rows equal in both any one stays: always
    exactly one row a group. A null id is smaller than all others; if it is the one that stays,
    ``dup_keep_id`` is null. Null and empty texts are equal to each other. Long texts are
    compared whole. Empty table: empty result. Columns pass through whatever their
    names, unless they bear one of the four ``dup_`` names.

    Hashes that stand for several texts (found by comparing the bytes) are split by the
    texts themselves.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    names = [id_col] if columns is None else list(columns)
    raw = F.col(f"`{text_col}`")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_cols"), F.col(f"`{id_col}`").cast("long").alias("_raw_id"),
                       F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(raw).alias("_tie"),
                       normalise(raw).alias("_t"))
    base = base.select("*", content(F.col("_t")).alias("_h"), F.unhex(F.sha2("_t", 256)).alias("_sha"))
    rows = staged(base.drop("_t").withColumn("_row", F.monotonically_increasing_id()), "exact-rows")

    repeated = staged(rows.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"), "exact-repeated")
    texts = prefiltered(base.select("_h", "_t"), F.xxhash64("_h"), repeated, F.xxhash64("_h"))
    # One row for each different text (grouping keys are compared byte by byte), then the hashes with several.
    collided = staged(texts.groupBy("_h", "_t").agg(F.lit(1).alias("_one")).groupBy("_h").agg(F.count("*").alias("_texts"))
                      .where("_texts > 1").select("_h"), "exact-collided")

    largest = keep == "largest"
    if collided.isEmpty():
        decided = _decide(rows, ["_h"], largest)
    else:
        split = staged(base.join(collided, "_h", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "exact-split")
        decided = (_decide(rows.join(collided, "_h", "left_anti"), ["_h"], largest)
                   .unionByName(_decide(split, ["_h", "_t"], largest).drop("_t")))
    alone = F.col("_n").isNull()
    keep_id = F.when(alone, F.col("_raw_id")).otherwise(F.when(F.col("_keep") == NULL_ID, F.lit(None).cast("long")).otherwise(F.col("_keep")))
    return decided.select("_cols.*", keep_id.alias("dup_keep_id"), F.coalesce("_n", F.lit(1).cast("long")).alias("dup_size"),
                          (alone | (F.col("_row") == F.col("_first"))).alias("dup_kept"), F.lower(F.hex("_sha")).alias("dup_sha256"))


def unique(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (``options`` as in ``groups``)."""
    cols = docs.columns
    return groups(docs, columns=cols, **options).where("dup_kept").select(*[F.col(f"`{c}`") for c in cols])


#: Equal texts by their bytes, without a hash.
ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
