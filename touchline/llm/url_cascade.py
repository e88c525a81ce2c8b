"""URL filtering by Bloom filter cascades: exact membership without joins.

The keys that pages can ask about are known in full (the corpus's universe), so a
filter's mistakes are known too. Level 1 encodes the listed keys, level 2 the keys
that level 1 lets through wrongly, level 3 the listed ones that level 2 lets
through, and so on until a level makes no mistake. A key is looked up level by
level; the first level that does not hold it decides, and the answer is exact for
every key of the universe.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import staged

#: The rules, longest first to win: verdict and (host, path) as one string.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Keys of the universe that one shard's cascade is built for, about; a shard is built in one task.
SHARD_KEYS = 50_000
#: Bytes of filters that travel to the tasks at once. Beyond it, the rows are judged in so many more passes.
BLOCK_BYTES = 64 << 20
#: A level's share of wrongly held keys, after the first.
LATER_RATE = 0.5
#: Runs of symbols from which a page's markup counts as junk; such pages' addresses are listed by the query.
JUNK_RUNS = 20
JUNK = r"%%%|\*\*\*|###|\$\$\$"

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


# ---- one shard's cascade (plain arrays) ----

@dataclass
class Level:
    bits: np.ndarray  # bytes
    n_bits: int
    hashes: int


def _slots(a: np.ndarray, b: np.ndarray, n_bits, hashes: int, level: int) -> Iterator[np.ndarray]:
    """Bit numbers of keys (two 64-bit hashes each) at a level."""
    with np.errstate(over="ignore"):
        x = (a + np.uint64(_MIX[0]) * np.uint64(level + 1)) * np.uint64(_MIX[1])
        x ^= x >> np.uint64(31)
        step = (b ^ (x << np.uint64(1))) | np.uint64(1)
        for i in range(hashes):
            y = x + np.uint64(i) * step
            y ^= y >> np.uint64(33)
            yield y % n_bits


def _holds(level: Level, number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.ones(len(a), dtype=bool)
    for s in _slots(a, b, np.uint64(level.n_bits), level.hashes, number):
        out &= (level.bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def build_cascade(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[Level]:
    """Levels for keys given by two 64-bit hashes. Keys whose hashes agree must agree in ``listed``."""
    inside, outside, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(inside):
        rate = min(0.5, max(len(inside) / max(len(outside), 1) / math.sqrt(2), 1e-6)) if not levels else LATER_RATE
        hashes = max(1, round(-math.log2(rate)))
        n_bits = max(64, math.ceil(len(inside) * hashes / math.log(2)))
        level = Level(np.zeros((n_bits + 7) // 8, dtype=np.uint8), n_bits, hashes)
        for s in _slots(a[inside], b[inside], np.uint64(n_bits), hashes, len(levels)):
            np.bitwise_or.at(level.bits, s >> np.uint64(3), np.left_shift(1, (s & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        wrong = outside[_holds(level, len(levels), a[outside], b[outside])]
        levels.append(level)
        inside, outside = wrong, inside
        if len(levels) > 200:
            raise ValueError("two keys, one listed and one not, have the same 128-bit hash")
    return levels


def in_cascade(levels: Sequence[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key is listed: exact for keys of the universe."""
    out = np.full(len(a), len(levels) % 2 == 1)
    open_ = np.arange(len(a))
    for i, level in enumerate(levels):
        held = _holds(level, i, a[open_], b[open_])
        out[open_[~held]] = i % 2 == 1
        open_ = open_[held]
    return out


# ---- Spark ----

def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.concat(F.lit("\u0001"), key)).alias("b")]


def _shard(a: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(a, 7), F.lit(shards)).cast("int")


def build(universe: DataFrame, shards: int) -> DataFrame:
    """``(key string, listed boolean)`` rows, repeats allowed -> one row per shard and level:
    ``(shard, level, n_bits, hashes, bits)``.

    Repeats are merged map-side (a key is listed if any of its rows says so) before the
    one shuffle. A shard holds ``SHARD_KEYS`` keys on average by hash, however often
    a key occurs, so no task grows with the corpus.
    """
    keys = (universe.where(F.col("key").isNotNull()).select(*_hashes(F.col("key")), "listed")
            .groupBy("a", "b").agg(F.max("listed").alias("listed"))
            .withColumn("shard", _shard(F.col("a"), shards)))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        levels = build_cascade(frame["a"].to_numpy().view(np.uint64), frame["b"].to_numpy().view(np.uint64), frame["listed"].to_numpy(dtype=bool))
        return pd.DataFrame({"shard": int(frame["shard"].iloc[0]), "level": range(len(levels)), "n_bits": [x.n_bits for x in levels],
                             "hashes": [x.hashes for x in levels], "bits": [x.bits.tobytes() for x in levels]})

    kinds = "shard int, level int, n_bits long, hashes int, bits binary"
    return staged(keys.groupBy("shard").applyInPandas(one, kinds), "cascade")


def _blocks(filters: DataFrame) -> list[list[int]]:
    """Shards in runs whose filters fill at most ``BLOCK_BYTES`` together."""
    runs, room = [[]], BLOCK_BYTES
    for r in filters.groupBy("shard").agg(F.sum(F.length("bits")).alias("size")).orderBy("shard").collect():
        if r["size"] > room and runs[-1]:
            runs.append([])
            room = BLOCK_BYTES
        runs[-1].append(r["shard"])
        room -= r["size"]
    return runs


def look_up(rows: DataFrame, keys_col: str, filters: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``listed``: array<boolean>, one for each of the strings in ``keys_col``.

    Filters travel to the tasks in blocks of at most ``BLOCK_BYTES``; each block is one
    map over the rows that answers for its own shards, so neither the rows nor the
    filters are shuffled or joined. A null key is not listed.
    """
    probe = rows.withColumn("_a", F.transform(keys_col, lambda k: F.xxhash64(k))).withColumn(
        "_b", F.transform(keys_col, lambda k: F.xxhash64(F.concat(F.lit("\u0001"), k))))
    found = None
    for block in _blocks(filters):
        levels: dict[int, list[Level]] = {}
        for r in filters.where(F.col("shard").isin(block) if block else F.lit(False)).orderBy("shard", "level").collect():
            levels.setdefault(r["shard"], []).append(Level(np.frombuffer(r["bits"], dtype=np.uint8), r["n_bits"], r["hashes"]))
        shared = rows.sparkSession.sparkContext.broadcast(levels)

        @F.pandas_udf("array<boolean>")
        def hit(a: pd.Series, b: pd.Series) -> pd.Series:
            size = np.array([0 if x is None else len(x) for x in a])
            flat_a = np.concatenate([np.empty(0, np.int64), *[x for x in a if x is not None]]).astype(np.int64).view(np.uint64)
            flat_b = np.concatenate([np.empty(0, np.int64), *[x for x in b if x is not None]]).astype(np.int64).view(np.uint64)
            shard = (flat_a >> np.uint64(7)) % np.uint64(shards)
            out, order = np.zeros(len(flat_a), dtype=bool), np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                if mine := shared.value.get(int(shard[part[0]])):
                    out[part] = in_cascade(mine, flat_a[part], flat_b[part])
            return pd.Series(np.split(out, np.cumsum(size)[:-1]) if len(size) else [])

        now = hit("_a", "_b")
        found = now if found is None else F.zip_with(found, now, lambda x, y: x | y)
    return probe.withColumn("listed", found).drop("_a", "_b")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_candidates(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every rule string that could fit: the host and its parent domains, each with the
    path's prefixes of the lengths that rules have (slash included)."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    return F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, listed: Column, rules: Sequence[tuple[str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url",
          shards: int | None = None) -> DataFrame:
    """One row per page: ``(page_id, host, path, rule, verdict, listed)``.

    listed: a condition on a page that puts its address (host and path) on the block
    list. Rules are strings ``host/path``; a rule fits its host and all subdomains of
    it where the url's path starts with the rule's, and the longest that fits decides
    (of equal length, the one with the longer host). Where none fits, ``block`` if
    the address is listed, else ``allow``. Both the rules and the list are looked up
    in one cascade whose universe is every address of the corpus and every rule that
    any of its urls could ask for, so all answers are exact.

    A null url, or one without ``://``: host and path empty, no rule; such a page's
    address is the empty one, which is listed if any such page is. Each row is judged
    by itself, repeats included; an address is listed if any of its pages is. Empty
    table: empty result.
    """
    action = {r: verdict for verdict, r in rules}
    lengths = sorted({len(r) - r.index("/") for r in action})
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(listed, F.lit(False)).alias("_listed"))
    rows = (rows.withColumn("_address", F.concat(F.lit("u:"), "host", "path"))
            .withColumn("_keys", F.concat(F.array("_address"), F.transform(rule_candidates(F.col("host"), F.col("path"), lengths), lambda c: F.concat(F.lit("r:"), c)))))
    rows = staged(rows, "url-keys")
    listed_rules = F.col("key").isin(*[f"r:{r}" for r in action]) if action else F.lit(False)
    universe = (rows.select(F.explode("_keys").alias("key"), "_listed", "_address")
                .select("key", F.when(F.col("key").startswith("u:"), F.col("_listed")).otherwise(listed_rules).alias("listed")))
    if shards is None:
        keys = universe.agg(F.approx_count_distinct("key")).first()[0]
        shards = max(1, math.ceil(keys / SHARD_KEYS))
    found = look_up(rows, "_keys", build(universe, shards), shards)
    fitting = F.filter(F.transform(F.arrays_zip("_keys", "listed"), lambda z: F.when(z["listed"] & z["_keys"].startswith("r:"), F.substr(z["_keys"], F.lit(3)))), lambda r: r.isNotNull())
    longest = F.element_at(F.array_sort(F.transform(fitting, lambda r: F.struct(F.length(r).alias("n"), F.instr(r, "/").alias("h"), r.alias("r")))), -1)["r"]
    rule = F.when(F.size(fitting) > 0, longest)
    verdicts = F.create_map(*[F.lit(x) for kv in action.items() for x in kv]) if action else F.lit(None).cast("map<string,string>")
    on_list = F.element_at("listed", 1)
    return found.withColumn("rule", rule).select(
        "page_id", "host", "path", "rule",
        F.coalesce(F.when(F.col("rule").isNotNull(), F.element_at(verdicts, F.col("rule"))), F.when(on_list, "block").otherwise("allow")).alias("verdict"),
        on_list.alias("listed"))


def junk_page(html: str = "html") -> Column:
    """The query's list: pages whose markup holds ``JUNK_RUNS`` runs of symbols or more."""
    return F.regexp_count(F.coalesce(F.col(html), F.lit("")), F.lit(JUNK)) >= JUNK_RUNS


ORACLE = r"""
WITH p AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, html,
             coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
l AS (SELECT host, path, bool_or(len(regexp_extract_all(coalesce(html, ''), '%%%|\*\*\*|###|\$\$\$')) >= 20) AS listed FROM h GROUP BY host, path),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT h.page_id, h.host, h.path, r.verdict, r.host || r.path AS rule,
             row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
      FROM h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.verdict, CASE WHEN l.listed THEN 'block' ELSE 'allow' END) AS verdict, l.listed
FROM f JOIN l ON f.host = l.host AND f.path = l.path WHERE k = 1
"""
