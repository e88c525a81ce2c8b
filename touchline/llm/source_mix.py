"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a fixed 60-bit hash. A source's target is met by taking each
of its documents a whole number of times and, for the fraction that is left,
the documents whose hash lies at or below the source's threshold. The threshold
comes from histograms: words are summed by source and hash bucket, the bucket
in which the budget runs out is found, and only that bucket is refined by the
next bits, down to single hashes. No document is ever sorted, and raising a
budget only ever adds documents (the taken sets are nested).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: What counts as a word: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and how many of them each histogram level resolves.
HASH_BITS = 60
LEVELS = (12, 12, 36)


def doc_hash(id_col: str) -> Column:
    """The first 60 bits of the MD5 of the id's text (null: the empty text)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _source_key(source_col: str) -> list[Column]:
    s = F.col(source_col).cast("string")
    return [F.coalesce(s, F.lit("")).alias("_s"), s.isNull().alias("_n")]


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(_s, _n, size)`` rows of documents -> one row per source: ``(_s, _n, source_size, target)``.

    Sources in code point order, null last, take ``weights`` in turn. Together they
    share ``share`` times all words by weight; a source stops at ``cap`` times its
    own size and the excess is shared again by weight until nobody is above. With
    sources ordered by cap over weight, that fixed point is one level L:
    target = min(cap, L * weight), and L is what is left for the first source
    that stays under its cap. The windows run over one row per source.
    """
    order = Window.orderBy("_n", "_s")
    by_ratio = Window.orderBy("_ratio", "_n", "_s")
    until = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = (sizes.groupBy("_s", "_n").agg(F.sum("size").alias("source_size"))
           .withColumn("_w", weight)
           .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
           .withColumn("_ratio", F.col("_cap") / F.col("_w"))
           .withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(everything))
           .withColumn("_allw", F.sum("_w").over(everything))
           .withColumn("_rest", F.col("_total") - (F.sum("_cap").over(until) - F.col("_cap")))
           .withColumn("_restw", F.col("_allw") - (F.sum("_w").over(until) - F.col("_w")))
           .withColumn("_under", F.col("_ratio") * F.col("_restw") > F.col("_rest"))
           .withColumn("_rank", F.row_number().over(by_ratio))
           .withColumn("_level", F.min(F.when(F.col("_under"), F.struct("_rank", "_rest", "_restw"))).over(everything)))
    target = F.when(F.col("_level").isNull() | (F.col("_rank") < F.col("_level._rank")), F.col("_cap")).otherwise(
        F.least(F.col("_cap"), F.col("_level._rest") * F.col("_w") / F.col("_level._restw")))
    return per.select("_s", "_n", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Adds ``full`` (times every document is taken) and ``cut`` (hashes up to it are
    taken once more; -1: none) to the sources.

    rows: ``(_s, _n, _hash, size)``. Of the documents at one hash, either all or none
    are taken; the boundary hash is taken if that comes nearer to the budget.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = staged(per_source.withColumn("full", full)
                   .withColumn("_need", F.col("target") - F.col("full") * F.col("source_size")), "mix-state")
    inside, open_, shift, prefix = rows, state.select("_s", "_n", "_need", F.lit(0).cast("long").alias("_prefix")), HASH_BITS, None
    for level, bits in enumerate(LEVELS):
        shift -= bits
        if prefix is not None:
            near = open_.select("_s", "_n", F.col("_prefix").alias("_at"))
            inside = staged(inside.withColumn("_at", F.shiftright("_hash", shift + bits)).join(near, ["_s", "_n", "_at"]).drop("_at"), "mix-boundary")
        run = Window.partitionBy("_s", "_n").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = (inside.groupBy("_s", "_n", F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("size").alias("_words"))
                .withColumn("_upto", F.sum("_words").over(run)))
        crossing = (hist.join(open_.select("_s", "_n", "_need"), ["_s", "_n"]).where(F.col("_upto") > F.col("_need"))
                    .groupBy("_s", "_n").agg(F.min(F.struct("_bucket", "_upto", "_words", "_need")).alias("b")))
        prefix = F.col("b._bucket")
        open_ = staged(crossing.select("_s", "_n", prefix.alias("_prefix"), F.col("b._words").alias("_words"),
                                       (F.col("b._need") - (F.col("b._upto") - F.col("b._words"))).alias("_need")), "mix-level")
    nearer = F.col("_words") <= 2 * F.col("_need")
    cuts = open_.select("_s", "_n", F.when(nearer, F.col("_prefix")).otherwise(F.col("_prefix") - 1).alias("cut"))
    return staged(state.drop("_need").join(cuts, ["_s", "_n"], "left").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long"))), "mix-cuts")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, *,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] | None = None) -> DataFrame:
    """Each row of ``docs`` (columns ``keep``; all of them if None) with ``mix_size`` (words of its
    text), ``mix_source_size``, ``mix_target`` (of its source), ``mix_copies`` and ``mix_taken`` (words
    that the mix takes of it: copies times size).

    Words are counted once, into a narrow staged table. Its histograms have at most
    2**12 rows a source and level, so a source with a third of all rows costs its
    tasks no more than another; the documents themselves are not shuffled unless
    there are too many sources to broadcast, in which case the join to the staged
    sources is one that Spark splits where it is skewed.

    Null or empty text: size 0, taken 0. Null source: a source of its own, the last.
    Rows with the same id share a hash, so they are taken or left together. Empty
    table: empty result. Other columns pass through, whatever their names, unless
    they bear one of the five ``mix_`` names.
    """
    cols = list(docs.columns if keep is None else keep)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = staged(docs.select(*_source_key(source_col), doc_hash(id_col).alias("_hash"), size.alias("size")), "mix-sizes")
    cuts = thresholds(rows, targets(rows, weights, share, cap))
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), *_source_key(source_col), doc_hash(id_col).alias("_hash"), size.alias("mix_size"))
    copies = F.col("full") + (F.col("_hash") <= F.col("cut")).cast("long")
    return (mine.join(cuts, ["_s", "_n"])
            .select("_row.*", "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
                    copies.alias("mix_copies"), (copies * F.col("mix_size")).alias("mix_taken")))


#: The same by plain SQL: targets by the level, thresholds by running sums over the sorted hashes.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
      FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS c, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS rk,
             1.5::DOUBLE * sum(source_size) OVER () - (sum(2.0::DOUBLE * source_size) OVER o - 2.0::DOUBLE * source_size) AS rest,
             sum(w) OVER () - (sum(w) OVER o - w) AS restw
      FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min(rk) AS rk FROM r WHERE c / w * restw > rest),
t AS (SELECT r.source, r.source_size, CASE WHEN l.rk IS NULL OR r.rk < l.rk THEN r.c
             ELSE least(r.c, f.rest * r.w / f.restw) END AS target
      FROM r CROSS JOIN l LEFT JOIN r f ON f.rk = l.rk),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS words, (sum(sum(size)) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM d GROUP BY source, h),
k AS (SELECT g.source, g.h, g.upto <= b.target - b.times * b.source_size
             OR (g.upto - words <= b.target - b.times * b.source_size AND words <= 2 * (b.target - b.times * b.source_size - (upto - words))) AS more
      FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.times + CASE WHEN k.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
