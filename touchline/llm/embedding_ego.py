"""Near-duplicate vectors by an epsilon grid order join.

Cosine c between unit vectors is Euclidean distance sqrt(2 - 2c). Vectors are laid
on a grid of that width along their leading principal directions and sorted by
grid cell, first direction first. Whatever is linked lies within one cell of each
other in every direction, so the sequence is cut into intervals and two intervals
are compared only if their bounding boxes come that near; intervals are halved and
asked again until they are small, and only then are vectors multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import NULL_ID, Forest, components, staged

#: Rows of the sorted sequence that make one interval of the join's tasks.
INTERVAL = 4_096
#: Intervals are halved down to so many rows.
LEAF = 512
#: Principal directions that span the grid.
DIRECTIONS = 4
#: Vectors, about, that the directions are fitted on (a share of the rows by hash); they
#: decide only how much is skipped, never what is linked.
FIT_ROWS = 20_000


def usable(vector: Column) -> Column:
    """The vector as array<double>; null where it, or a component, is null or not finite, or all are zero."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad & F.exists(doubles, lambda x: x != 0), doubles)


def unit_rows(vectors: pd.Series, width: int) -> np.ndarray:
    """Unit vectors as rows, filled up with zeros to ``width``."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _directions(classes: DataFrame, rows: int, width: int) -> np.ndarray:
    """Leading principal directions as columns, from a bounded sample by hash."""
    share = min(1.0, FIT_ROWS / max(rows, 1))
    sample = classes.where(F.pmod(F.xxhash64("v2"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("v").toPandas()
    if not len(sample):
        return np.eye(width)[:, :DIRECTIONS]
    x = unit_rows(sample["v"], width)
    x -= x.mean(axis=0)
    _, axes = np.linalg.eigh(x.T @ x)
    return axes[:, ::-1][:, :DIRECTIONS]


def _place(classes: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Adds ``p`` (coordinates along the directions) and ``cell``."""
    width = axes.shape[0]

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(unit_rows(vectors, width) @ axes)) if len(vectors) else pd.Series([], dtype=object)

    placed = classes.withColumn("p", project("v"))
    return placed.withColumn("cell", F.transform("p", lambda x: F.floor(x / eps).cast("int")))


def _sequence(placed: DataFrame, classes: int) -> DataFrame:
    """Adds ``interval``: the place in grid order divided by ``INTERVAL``."""
    tasks = max(1, math.ceil(classes / INTERVAL))
    ordered = placed.repartitionByRange(tasks, "cell", "cid", "v1").sortWithinPartitions("cell", "cid", "v1")

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for f in frames:
            yield f.assign(place=np.arange(n, n + len(f)))
            n += len(f)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    numbered = staged(ordered.withColumn("part", F.spark_partition_id()).mapInPandas(number, f"{kinds}, part int, place long"), "ego-order")
    # one row a partition of INTERVAL rows
    before = numbered.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return staged(numbered.join(before, "part").withColumn("interval", F.floor((F.col("place") + F.col("before")) / INTERVAL))
                  .drop("part", "place", "before"), "ego-sequence")


def _near_intervals(sequence: DataFrame, eps: float) -> DataFrame:
    """Pairs ``(a, b)``, a <= b, of intervals whose boxes come within eps."""
    axes = range(DIRECTIONS)
    box = sequence.groupBy("interval").agg(
        F.min(F.element_at("cell", 1)).alias("first"), F.max(F.element_at("cell", 1)).alias("last"),
        F.array(*[F.min(F.get("p", F.lit(k))) for k in axes]).alias("low"), F.array(*[F.max(F.get("p", F.lit(k))) for k in axes]).alias("high"))
    box = staged(box, "ego-boxes")
    a = box.select(F.col("interval").alias("a"), F.explode(F.sequence("first", F.col("last") + 1)).alias("at"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    b = box.select(F.col("interval").alias("b"), F.col("first").alias("at"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    gap = sum((F.coalesce(F.pow(F.greatest(F.get("low_b", F.lit(k)) - F.get("high_a", F.lit(k)), F.get("low_a", F.lit(k)) - F.get("high_b", F.lit(k)), F.lit(0.0)), F.lit(2.0)), F.lit(0.0))
               for k in axes), F.lit(0.0))
    return a.join(b, "at").where((F.col("a") <= F.col("b")) & (gap <= eps * eps)).select("a", "b")


def _join(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, eps: float, at_x=0, at_y=0) -> Iterator[tuple[int, int, np.ndarray]]:
    """Cosines of blocks of rows of x and y that may hold links: (first row, first row, cosines)."""
    if not len(x) or not len(y):
        return
    gap = np.maximum(0, np.maximum(py.min(axis=0) - px.max(axis=0), px.min(axis=0) - py.max(axis=0)))
    if (gap * gap).sum() > eps * eps:
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        yield at_x, at_y, x @ y.T
    elif len(x) >= len(y):
        h = len(x) // 2
        yield from _join(x[:h], px[:h], y, py, eps, at_x, at_y)
        yield from _join(x[h:], px[h:], y, py, eps, at_x + h, at_y)
    else:
        h = len(y) // 2
        yield from _join(x, px, y[:h], py[:h], eps, at_x, at_y)
        yield from _join(x, px, y[h:], py[h:], eps, at_x, at_y + h)


def link(vectors: DataFrame, threshold: float = 0.95, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``(vec_id, n_links, component_id, kept)``.

    Two rows are linked if their cosine, in double precision, is ``threshold`` or more;
    ``n_links`` counts the other rows a row is linked to, ``component_id`` is the
    smallest id that links reach, itself included, ``kept`` says that it is the row's own.

    Rows with the same vector are one class (merged map-side, so a vector that a third
    of the rows have is one row) and are not compared with each other. A task joins
    two intervals of classes; of what it finds, only a sum per class and a spanning
    forest leave it, never the pairs.

    Vectors that are null, zero, or hold null or non-finite components, and vectors of
    different lengths, link with nothing. A null id counts as the smallest, comes
    back as null and is kept if it is its component's. Rows that repeat an id are
    rows of their own. Empty table: empty result.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), usable(F.col(vector_col)).alias("v"))
    rows = rows.withColumn("v1", F.xxhash64("v")).withColumn("v2", F.xxhash64(F.lit(1), "v"))
    classes = staged(rows.where(F.col("v").isNotNull()).groupBy("v1", "v2").agg(F.min("id").alias("cid"), F.count("*").alias("n"), F.first("v").alias("v"))
                     .withColumn("width", F.size("v")), "ego-classes")
    count, width = classes.agg(F.count("*"), F.max("width")).first()
    width = width or 1
    sequence = _sequence(_place(classes, _directions(classes, count, width), eps), count)
    pairs = staged(_near_intervals(sequence, eps), "ego-pairs")
    sides = pairs.select("a", "b", F.col("a").alias("interval")).unionByName(pairs.where("a <> b").select("a", "b", F.col("b").alias("interval")))
    # A class is known by v1, v2; nodes of the links are the ids, which classes of one id share.
    members = sequence.select("interval", "cid", "v1", "v2", "n", "width", "v", "p").join(sides, "interval")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
        side = frame["interval"].to_numpy()
        order = np.lexsort((*np.stack(list(frame["p"])).T[::-1], side))
        frame, side = frame.iloc[order], side[order]
        unit, p = unit_rows(frame["v"], int(frame["width"].max())), np.stack(list(frame["p"]))
        size, many = frame["width"].to_numpy(), frame["n"].to_numpy()
        left = np.flatnonzero(side == a)
        right = left if a == b else np.flatnonzero(side == b)
        added, forest = np.zeros(len(frame), dtype=np.int64), Forest(len(frame))
        for i, j, cosine in _join(unit[left], p[left], unit[right], p[right], eps):
            x, y = left[i:i + cosine.shape[0]], right[j:j + cosine.shape[1]]
            hit = (cosine >= threshold) & (size[x][:, None] == size[y]) & (x[:, None] != y)
            if hit.any():
                added[x] += hit @ many[y]
                if a != b:
                    added[y] += many[x] @ hit
                forest.link(hit, x, y)
        own, root = forest.edges()
        some = np.flatnonzero(added)
        ids, v1, v2 = (frame[c].to_numpy() for c in ("cid", "v1", "v2"))
        return pd.DataFrame({"v1": np.concatenate((v1[some], v1[own])), "v2": np.concatenate((v2[some], v2[own])),
                             "added": np.concatenate((added[some], np.zeros(len(own), np.int64))),
                             "u": ids[np.concatenate((some, own))], "v": ids[np.concatenate((some, root))]})

    found = staged(members.groupBy("a", "b").applyInPandas(meet, "v1 long, v2 long, added long, u long, v long"), "ego-links")
    degree = found.groupBy("v1", "v2").agg(F.sum("added").alias("added"))
    root = components(found.select("u", "v"), "ego-components")
    result = staged(classes.select("v1", "v2", "cid", "n").join(degree, ["v1", "v2"], "left")
                    .join(root, F.col("cid") == F.col("node"), "left")
                    .select("v1", "v2", (F.col("n") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "ego-classes-out")
    linked = (rows.where(F.col("v").isNotNull()).select("id", "v1", "v2").join(result, ["v1", "v2"]).select("id", "n_links", "root")
              .unionByName(rows.where(F.col("v").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("root"))))
    return linked.select(F.nullif("id", F.lit(NULL_ID)).alias("vec_id"), "n_links", F.nullif("root", F.lit(NULL_ID)).alias("component_id"), (F.col("id") == F.col("root")).alias("kept"))
