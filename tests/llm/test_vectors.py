"""MaxScore and the epsilon grid order join against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import embedding_ego as EGO
from touchline.llm import maxscore as M

ODD = [(901, None), (902, []), (903, [1.0, None]), (904, [float("nan"), 1.0]), (905, [float("inf"), 1.0]), (906, [0.0, 0.0]), (907, [1.0]), (908, [1e-30, 0.0]), (None, [0.3, 0.1, 0.2, 0.1]), (909, [1e30, 1e30, 0.0, 0.0])]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, None) for i, v in rows], "vec_id long, embedding array<float>, v string, n long")


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def clustered(rnd, n, dims=8, spread=0.1):
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(max(2, n // 20))]
    return [[float(np.float32(x + rnd.gauss(0, spread))) for x in rnd.choice(centres)] for _ in range(n)]


def brute_top(rows, is_query, k):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if good(v)]
    out = set()
    for qi, q in whole:
        if qi is not None and is_query(qi):
            scored = sorted((-sum(a * b for a, b in zip(q, v)), math.inf if i is None else i) for i, v in whole if i != qi)
            out |= {(qi, r + 1, None if i == math.inf else i, min(max(-s, -2**63), 2**63 - 1)) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_search(spark, monkeypatch, k):
    monkeypatch.setattr(M, "SHARD_ROWS", 60)
    monkeypatch.setattr(M, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(M, "STRIDE", 16)
    rnd = random.Random(k)
    rows = list(enumerate(clustered(rnd, 300))) + ODD + [(400, [0.0] * 8), (401, [-1.0] * 8)]
    got = M.search(vectors(spark, rows), F.col("vec_id") % 10 == 0, k).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute_top(rows, lambda i: i % 10 == 0, k)


def test_search_prunes_and_stays_exact():
    """One shard, sparse non-negative vectors, where most terms become non-essential."""
    rnd = np.random.default_rng(3)
    values = np.where(rnd.random((5_000, 40)) < 0.15, rnd.integers(1, 400, (5_000, 40)), 0) * np.geomspace(1, 40, 40).astype(int)
    shard = M.Shard(np.arange(5_000), values, int(values.max()))
    for q in range(0, 200, 10):
        score = values @ values[q]
        score[q] = -1
        want = sorted(((-s, i) for i, s in enumerate(score) if i != q))[:5]
        ids, got = shard.top(q, values[q], 5)
        assert [(-s, i) for i, s in zip(ids, got)] == want


def test_search_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5])]
    got = M.search(vectors(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in got] == [(1, 1), (2, 2)]
    empty = vectors(spark, [])
    assert M.search(empty, F.col("vec_id") == 0).count() == 0


def brute_links(rows, t):
    unit = [None if not good(v) or not any(v) else np.array(v, dtype=np.float32).astype(float) for _, v in rows]
    unit = [u if u is None else u / np.abs(u).max() for u in unit]
    unit = [u if u is None else u / np.sqrt(u @ u) for u in unit]
    n, root = len(rows), list(range(len(rows)))
    degree = [0] * n
    key = lambda i: -math.inf if rows[i][0] is None else rows[i][0]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t:
                degree[i] += 1
                degree[j] += 1
                a, b = sorted((find(i), find(j)), key=key)
                root[b] = a
    return sorted(((str(rows[i][0]), degree[i], str(rows[find(i)][0]), rows[i][0] == rows[find(i)][0]) for i in range(n)))


@pytest.mark.parametrize("t", [0.8, 0.95, 0.999])
def test_links(spark, monkeypatch, t):
    monkeypatch.setattr(EGO, "INTERVAL", 50)
    monkeypatch.setattr(EGO, "LEAF", 8)
    rnd = random.Random(11)
    base = clustered(rnd, 250, spread=0.15)
    rows = list(enumerate(base)) + [(300 + i, base[0]) for i in range(30)] + [(400 + i, [3 * x for x in base[1]]) for i in range(3)] + ODD
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in EGO.link(vectors(spark, rows), t).collect())
    assert got == brute_links(rows, t)


def test_links_empty(spark):
    assert EGO.link(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in EGO.link(vectors(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


def test_skipping_skips():
    """Far intervals are not multiplied."""
    x = np.eye(4)[[0] * 40]
    y = np.eye(4)[[1] * 40]
    assert not list(EGO._join(x, x[:, :2], y, y[:, :2], 0.3))
    assert list(EGO._join(x, x[:, :2], x, x[:, :2], 0.3))


def test_search_with_very_large_components(spark):
    """Beyond what doubles, and what products of 64 bits hold on the way."""
    big = [[600_000.0, 1.0], [700_000.0, -1.0], [1.0, 0.0], [-(2.0**40), 2.0**41], [2.0**45, -(2.0**44)], [2.0**45, -(2.0**44) - 2.0**21], [0.0, 3.0]]
    rows = list(enumerate(big))
    got = M.search(vectors(spark, rows), F.col("vec_id").isin(2, 6), 5).collect()
    assert {tuple(r) for r in got} == brute_top(rows, lambda i: i in (2, 6), 5)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got}[2, 3] == 1  # 700,000 before 600,000
    # the products pass 64 bits on the way, their sum does not
    far = [(0, [2.0**26, 2.0**26]), (1, [2.0**27, -(2.0**27)]), (2, [2.0**27, -(2.0**27) + 4.0])]
    assert {tuple(r) for r in M.search(vectors(spark, far), F.col("vec_id") == 0, 5).collect()} == brute_top(far, lambda i: i == 0, 5)
    # scores beyond 64 bits rank by what they are
    huge = [(0, [2.0**40]), (1, [2.0**40]), (2, [2.0**41]), (3, [-1e30]), (4, [1e30])]
    assert {tuple(r) for r in M.search(vectors(spark, huge), F.col("vec_id") == 0, 5).collect()} == brute_top(huge, lambda i: i == 0, 5)
