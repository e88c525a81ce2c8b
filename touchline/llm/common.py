"""Helpers shared by the corpus operators: staging, row identity, components."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import checkpoint_dir

#: Doc ids are coalesced to this before joins, so that a null id joins itself.
NULL_ID = -(2**63)
#: A node with more edges than this is a hub: its minimum reaches them by broadcast, so hubs are fewer than a HUBth of all edges.
HUB = 10_000


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again.

    Cuts the lineage with files that every executor can read, so a lost
    executor costs its running tasks only and nothing upstream is recomputed.
    Compressed by zstd, as tables of texts are large.
    """
    return _written(df, label, _scopes()[-1:])


class _Local(threading.local):
    """The lists of tables staged in each open ``scratch`` of a driver thread, the innermost last."""

    def __init__(self):
        self.scopes: list[list[str]] = []


_local = _Local()


def _scopes() -> list[list[str]]:
    return _local.scopes


def _written(df: DataFrame, label: str, owner: list[list[str]]) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{label}-{uuid.uuid4().hex}"
    for paths in owner:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the tables staged inside when it ends; what ``keep(df, label)``, the value it yields, has
    staged stays, and belongs to the scratch around this one, if any.

    Nothing that is still to be computed may read the deleted tables: results leave by ``keep``.
    """
    own: list[str] = []
    outer = _scopes()[-1:]
    _scopes().append(own)
    try:
        yield lambda df, label: _written(df, label, outer)
    finally:
        _scopes().remove(own)
        for path in own:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def doc_key(id_col: str, text_col: str) -> list[Column]:
    """Identity of a document row: ``_d`` (id, null made a value) and ``_h``.

    Rows that agree in id and text are one document to the operators that need
    an identity; each of those rows gets the document's result.
    """
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_d"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()).alias("_h")]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges(u, v)``: one row ``(node, root)`` for each
    node of an edge, ``root`` the smallest node reachable.

    Alternating large-star and small-star rounds; each round is a grouped
    minimum (combined map-side) joined back: by broadcast for hubs, so one with a
    third of all edges stays in the tasks that read them, else by shuffle. Rounds grow with
    the logarithm of the longest chain. Every round is staged; only a count and a checksum reach the driver.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)

    def star(arcs: DataFrame, keep: Column) -> DataFrame:
        """Arcs (u, v): links every kept v, and u itself, to the least of u and its v."""
        least = arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        known = arcs.join(F.broadcast(least.where(F.col("n") > HUB).select("u", "m")), "u", "left")
        light = known.where("m is null").drop("m").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
        return known.where("m is not null").unionByName(light).where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))

    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, F.col("v") > F.col("u")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = large  # u > v: the smaller neighbours of u
        small = (star(down, F.lit(True))
                 .unionByName(down.groupBy("u").agg(F.min("v").alias("v")))
                 .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        edges = staged(small, label)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == last:
            break
        last = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def linked_labels(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least node of each node's component in the two-sided graph ``hit`` (rows and columns are
    nodes, rows numbered first), for the rows and for the columns."""
    m, n = hit.shape
    rows, cols, none = np.arange(m), np.arange(m, m + n), m + n
    while True:
        new_rows = np.minimum(rows, np.where(hit, cols, none).min(axis=1, initial=none))
        new_cols = np.minimum(cols, np.where(hit, new_rows[:, None], none).min(axis=0, initial=none))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


class Forest:
    """Spanning forest of the links that one task finds: at most one edge a node, however many links."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Joins left[i] and right[j] wherever hit[i, j]."""
        nodes = np.concatenate((left, right))
        labels = np.concatenate(linked_labels(hit))
        for i in np.flatnonzero(labels != np.arange(len(labels))):
            a, b = self.root(int(nodes[i])), self.root(int(nodes[labels[i]]))
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self.root(x) for x in range(len(self.up))], dtype=np.int64)
        own = np.flatnonzero(roots != np.arange(len(roots)))
        return own, roots[own]


#: A prefilter's words of 64 bits: at most so many rows are broadcast, 16 bytes each.
PREFILTER_WORDS = 1 << 18


def marked(rows: DataFrame, rows_hash: Column, wanted: DataFrame, wanted_hash: Column) -> DataFrame:
    """``rows`` with ``_maybe``: false only where no row of ``wanted`` has the row's hash.

    A bitmap of 64 * ``PREFILTER_WORDS`` bits, built by Spark and broadcast: its size
    is bounded however many rows are wanted; with very many it merely says maybe more
    often. A join after it decides.
    """
    word, bit = "pmod({h}, %d)" % PREFILTER_WORDS, "cast(shiftrightunsigned({h}, 40) & 63 as int)"
    bitmap = (wanted.select(wanted_hash.alias("_w")).groupBy(F.expr(word.format(h="_w")).alias("_word"))
              .agg(F.bit_or(F.expr(f"shiftleft(1L, {bit.format(h='_w')})")).alias("_bits")))
    there = F.expr(f"coalesce(shiftrightunsigned(_bits, {bit.format(h='_p')}) & 1, 0) = 1")
    return (rows.withColumn("_p", rows_hash).withColumn("_word", F.expr(word.format(h="_p")))
            .join(F.broadcast(bitmap), "_word", "left").withColumn("_maybe", there).drop("_p", "_word", "_bits"))


def prefiltered(rows: DataFrame, rows_hash: Column, wanted: DataFrame, wanted_hash: Column) -> DataFrame:
    """``rows`` without most of those whose hash no row of ``wanted`` has, before a join on it."""
    return marked(rows, rows_hash, wanted, wanted_hash).where("_maybe").drop("_maybe")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal ``keys`` from a stream sorted by them; a run may span batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(frame)]
        if held and (held[-1][keys].to_numpy()[-1] != k[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for at, to in zip(cuts[:-2], cuts[1:-1], strict=True):
            part = frame.iloc[at:to]
            yield pd.concat([*held, part]) if held else part
            held = []
        held.append(frame.iloc[cuts[-2]:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
