"""Exact top-k by inner product with MaxScore over sharded postings.

Components are integers. Each dimension gives two terms, one for vectors that are
positive there and one for negative ones; a query owns, of each pair, the term
that can only add to a score. A term's bound is its weight in the query times its
largest posting in the shard. Once k candidates are known, the terms with the
smallest bounds, as many as cannot reach the k-th score together, are non-essential:
a vector that occurs in none but them cannot enter. So only essential postings
are traversed; the others, and the terms that take away, are probed for the vectors
that are still competitive. Shards answer for themselves and their lists are merged.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import staged

#: Rows of a shard and queries of a block, about; one task holds one of each.
SHARD_ROWS = 8_192
BLOCK_QUERIES = 1_024
#: Rows of a shard that are traversed before the k-th score is looked at again.
STRIDE = 2_048
#: Non-essential terms that are probed between two looks at who is still competitive.
PROBE = 8


def _largest(values: np.ndarray) -> int:
    return int(np.abs(values).max(initial=0))


def _exact(values: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    out = np.empty(values.shape, dtype=object)
    out[...] = [[int(x) for x in row] for row in values] if out.ndim == 2 else [int(x) for x in values]
    return out


class Shard:
    """Postings of one shard: rows of ``values``, whole doubles, are vectors; ``largest`` is the queries' largest component."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, largest: int):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        most = max(_largest(values), largest)
        big = _largest(values) * largest * max(1, values.shape[1])
        # whole numbers whatever the kind; doubles are the fastest, Python's own have no bound
        kind = np.float64 if max(big, most) < 2**52 else np.int64 if max(big, most) < 2**62 else object
        self.cast = _exact if kind is object else lambda v: v.astype(kind)
        values = self.cast(values)
        self.plus = np.ascontiguousarray(np.maximum(values, 0).T).astype(kind)
        self.minus = np.ascontiguousarray(np.maximum(-values, 0).T).astype(kind)
        self.most = np.stack((self.plus.max(axis=1, initial=0), self.minus.max(axis=1, initial=0)))

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but ``own``; ties to the smaller id."""
        terms = np.flatnonzero(query)
        positive = query[terms] > 0
        weight = np.abs(self.cast(query[terms]))
        bound = weight * np.where(positive, self.most[0][terms], self.most[1][terms])
        order = np.argsort(-bound, kind="stable")
        terms, positive, weight, bound = terms[order], positive[order], weight[order], bound[order]
        rest = np.concatenate((np.cumsum(bound[::-1])[::-1], [0]))  # bound of the terms from i on
        best_ids, best = np.empty(0, np.int64), np.empty(0, self.plus.dtype)
        for at in range(0, len(self.ids), STRIDE):
            part = slice(at, at + STRIDE)
            least = best[-1] if len(best) == k else None
            # essential: the terms before the first i whose remaining bounds can't reach the k-th score
            essential = len(terms) if least is None else int(np.searchsorted(-rest, -least, side="right"))
            rows = np.arange(at, min(at + STRIDE, len(self.ids)))
            gain = self._adds(terms[:essential], positive[:essential], weight[:essential], part)
            if least is not None:
                rows, gain = self._competitive(rows, gain, rest[min(essential, len(terms))], least)
                for i in range(essential, len(terms), PROBE):
                    j = min(i + PROBE, len(terms))
                    gain = gain + self._adds(terms[i:j], positive[i:j], weight[i:j], rows)
                    rows, gain = self._competitive(rows, gain, rest[j], least)
            score = gain - self._adds(terms, ~positive, weight, rows)
            other = self.ids[rows] != own
            ids, score = np.concatenate((best_ids, self.ids[rows][other])), np.concatenate((best, score[other]))
            first = np.lexsort((ids, -score))[:k]
            best_ids, best = ids[first], score[first]
        return best_ids, best

    @staticmethod
    def _competitive(rows, gain, still, least):
        on = gain + still >= least
        return rows[on], gain[on]

    def _adds(self, terms, positive, weight, rows) -> np.ndarray:
        """What the terms' postings give to the rows."""
        p, m = terms[positive], terms[~positive]
        return weight[positive] @ self._take(self.plus, p, rows) + weight[~positive] @ self._take(self.minus, m, rows)

    @staticmethod
    def _take(postings, terms, rows):
        return postings[terms, rows] if isinstance(rows, slice) else postings[np.ix_(terms, rows)]


def _in_64_bits(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        scores = np.array([min(max(s, -2**63), 2**63 - 1) for s in scores], dtype=np.int64)
    return scores.astype(np.int64)


def _matrix(vectors: pd.Series) -> np.ndarray:
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def whole(vector: Column) -> Column:
    """Each component x as floor(256 * x), x as double, a whole double; null where the vector or a component is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    usable = ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    def component(x: Column) -> Column:
        y = x * 256
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max)))

    return F.when(usable, F.transform(doubles, component))


def search(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row that ``is_query`` holds for, the k rows of
    ``vectors`` with the highest inner product of the integer components, rows with the
    query's own id left out; ties to the smaller id.

    Rows are dealt over shards and queries over blocks by hash; each shard meets each
    block in one task of bounded size, and at most k rows a query leave it. The lists
    of a query meet in a window that keeps k rows map-side first.

    Vectors that are null or hold a null or non-finite component take no part; shorter
    vectors count as filled up with zeros. Components of any size count exactly, and so do scores within a shard;
    a score beyond 64 bits is shown as the nearest that they hold, and meets those of other shards as
    a double. A null id is never a query, and as a candidate comes after all ids in ties. Rows
    that repeat a query's id and vector are one query. Fewer than k candidates: all
    of them. Empty table: empty result.
    """
    null_id = 2**63 - 1
    rows = staged(vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(null_id)).alias("id"), whole(F.col(vector_col)).alias("v"),
                                 F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"))
                  .where(F.col("v").isNotNull()), "maxscore")
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asking / BLOCK_QUERIES))

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    queries = (rows.where("asks").dropDuplicates(["id", "v"])
               .select(all_of(shards).alias("shard"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), F.xxhash64("v").alias("tag"), "id", "v"))
    held = rows.select(F.pmod(F.xxhash64("v", "id"), F.lit(shards)).cast("int").alias("shard"), all_of(blocks).alias("block"), F.lit(False).alias("asks"), F.lit(0).cast("long").alias("tag"), "id", "v")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy(dtype=bool)
        values, ids = _matrix(frame["v"]), frame["id"].to_numpy()
        shard = Shard(ids[~asks], values[~asks], _largest(values[asks]))
        out = []
        for own, q in zip(ids[asks], values[asks], strict=True):
            out.append(shard.top(own, q, k))
        size = [len(found) for found, _ in out]
        return pd.DataFrame({"query_id": np.repeat(ids[asks], size), "tag": np.repeat(frame["tag"][asks].to_numpy(), size),
                             "vec_id": np.concatenate([i for i, _ in out] or [[]]), "score": np.concatenate([_in_64_bits(s) for _, s in out] or [[]]),
                             "rough": np.concatenate([s.astype(np.float64) for _, s in out] or [[]])})

    each = queries.unionByName(held).groupBy("shard", "block").applyInPandas(meet, "query_id long, tag long, vec_id long, score long, rough double")
    first = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), F.desc("rough"), "vec_id")
    return (each.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(null_id)).alias("vec_id"), "score"))


#: Brute force in SQL.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5
"""
