"""Near-duplicate documents: n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word n-grams. Candidates share a band of MinHash values. For
a candidate pair the values are compared a few at a time; with m of n equal and a
uniform prior, the Jaccard similarity has a Beta(m + 1, n - m + 1) posterior, and
as soon as the chance that it reaches the threshold falls below the tolerance, the
pair is dropped. Pairs that survive all values are verified exactly on their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import Forest, NULL_ID, components, doc_key, marked, prefiltered, runs, scratch, staged

#: Words of a shingle, and the similarity from which two documents are linked.
WORDS = 5
THRESHOLD = 0.8
#: MinHash values: bands of ROWS each. A pair at the threshold shares no band with probability
#: (1 - 0.8**4)**24, 3 in a million.
BANDS, ROWS = 24, 4
#: Values compared between two looks at the posterior, and the chance below which a pair goes.
STEP = 16
TOLERANCE = 1e-6
#: Members of one block of a bucket; a larger bucket is joined block by block.
BLOCK = 256
#: Shingles whose counts are multiplied out at once.
COLUMNS = 8_192

_U = np.uint64
_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> its lower case for letters and digits, else 0. Once a Python worker."""
    if not _TABLES:
        table = np.zeros(0x110000, dtype=np.uint64)
        for c in range(0x110000):
            if chr(c).isalnum():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLES.append(table)
    return _TABLES[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word: lower-cased run of letters and digits."""
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    inside = c != 0
    start = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    at = np.flatnonzero(inside)
    word = np.searchsorted(start, at, side="right") - 1
    place = (at - start[word]).astype(np.uint64)
    with np.errstate(over="ignore"):
        per = _mixed(c[at] + (place + _U(1)) * _U(0x9E3779B97F4A7C15))
        return _mixed(np.add.reduceat(per, np.searchsorted(at, start)))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of all word n-grams, ascending; a shorter text is one shingle, one without words none."""
    w = word_hashes(text or "")
    n = min(words, len(w))
    if not n:
        return w
    with np.errstate(over="ignore"):
        out = np.zeros(len(w) - n + 1, dtype=np.uint64)
        for i in range(n):
            out = out * _U(0x9DDFEA08EB382D69) + w[i:len(w) - n + 1 + i]
    return np.unique(_mixed(out + _U(n)))


_RANDOM = np.random.default_rng(20_011)
_A = _RANDOM.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * _U(2) + _U(1)
_B = _RANDOM.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)


def minhash(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS values of 32 bits."""
    out = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            out = np.minimum(out, ((_A * s[at:at + 4096] + _B) >> _U(32)).min(axis=1))
    return out.astype("<u4")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """n -> fewest matches among n values with which a pair stays.

    P(J >= t | m of n) = 1 - I_t(m + 1, n - m + 1) = P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        chance = 0.0
        for m in range(n + 1):
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                out[n] = m
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray | None, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i in a, j in b; i < j within a if b is None) of the pairs that pruning leaves."""
    first = a[:, :STEP]
    other = first if b is None else b[:, :STEP]
    same = np.zeros((len(a), len(other)), dtype=np.int16)
    for k in range(STEP):
        same += first[:, k][:, None] == other[:, k]
    on = same >= least[STEP]
    i, j = np.nonzero(np.triu(on, 1) if b is None else on)
    b = a if b is None else b
    matches = same[i, j].astype(np.int32)
    for n in range(2 * STEP, a.shape[1] + 1, STEP):
        matches = matches + (a[i, n - STEP:n] == b[j, n - STEP:n]).sum(axis=1)
        keep = matches >= least[n]
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of hashes."""
    sizes = [len(s) for s in sets]
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        m = np.zeros((len(sets), int(column[hi - 1]) + 1 - at), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out


_TASK = ["band", "bucket", "i", "j"]


def _sketch(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``_d, _h, v1, v2, n, sig``: identity, hash of the shingle set, its size, MinHash values."""
    slim = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v1, v2, n, sig = [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), words)
                a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8")
                v1.append(a)
                v2.append(b)
                n.append(len(s))
                sig.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_h"), pa.array(v1, pa.int64()), pa.array(v2, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())],
                                             names=["_d", "_h", "v1", "v2", "n", "sig"])

    return slim.mapInArrow(run, "_d long, _h long, v1 long, v2 long, n long, sig binary")


def _candidates(classes: DataFrame) -> DataFrame:
    """Members of buckets, block by block: the columns of _TASK, ``side``, and the class.

    Buckets with the same members are one; of those, the one of the lowest band is
    taken, so a pair is looked at where it first shares a band. A bucket of more than
    BLOCK members is cut into blocks by hash, and each pair of blocks is a task.
    """
    banded = classes.select("cid", "v1", F.posexplode(F.array(*[F.xxhash64(F.substring("sig", 1 + 4 * ROWS * k, 4 * ROWS)) for k in range(BANDS)])).alias("band", "bucket"))
    buckets = (banded.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid", "v1")).alias("f1"), F.bit_xor(F.xxhash64("v1", "cid")).alias("f2"))
               .where("n > 1").groupBy("n", "f1", "f2").agg(F.min(F.struct("band", "bucket")).alias("b"))
               .select("b.*", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    members = banded.join(staged(buckets, "jaccard-buckets"), ["band", "bucket"])
    return (members.withColumn("side", F.pmod(F.xxhash64("v1", "cid", "bucket"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("band", "bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "cid", "v1"))


def _prune(candidates: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Task members that have surviving partners: ``no`` numbers the members of a task, ``partners`` are numbers."""
    least = least_matches(threshold)
    rows = (candidates.join(classes.select("cid", "v1", "_h", "m", "sig"), ["cid", "v1"])
            .repartition(*_TASK).sortWithinPartitions(*_TASK, "side", "cid", "v1"))
    kinds = ", ".join(["band int, bucket long, i int, j int", "no int, partners array<int>, cid long, v1 long, _h long, m long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pd.DataFrame] = []
        for group in runs(batches, _TASK):
            sig = np.frombuffer(b"".join(group["sig"]), dtype="<u4").reshape(len(group), -1)
            band, i, j = (int(group[c].iloc[0]) for c in ("band", "i", "j"))
            if i == j:
                x, y = surviving(sig, None, least)
            else:
                cut = int((group["side"].to_numpy() == i).sum())
                x, y = surviving(sig[:cut], sig[cut:], least)
                y = y + cut
            if not len(x):
                continue
            shared = (sig[x].reshape(len(x), BANDS, ROWS) == sig[y].reshape(len(y), BANDS, ROWS)).all(axis=2)
            here = shared[:, band] & ~shared[:, :band].any(axis=1)
            x, y = x[here], y[here]
            if not len(x):
                continue
            used = np.unique(np.concatenate((x, y)))
            start = np.searchsorted(x, used)
            stop = np.searchsorted(x, used, side="right")
            part = group.iloc[used]
            out.append(pd.DataFrame({**{c: part[c].to_numpy() for c in _TASK}, "no": used.astype(np.int32), "partners": [y[a:b].astype(np.int32) for a, b in zip(start, stop, strict=True)],
                                     **{c: part[c].to_numpy() for c in ("cid", "v1", "_h", "m")}}))
            if sum(map(len, out)) >= 2_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    schema = pa.schema([("band", pa.int32()), ("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("no", pa.int32()), ("partners", pa.list_(pa.int32())),
                        ("cid", pa.int64()), ("v1", pa.int64()), ("_h", pa.int64()), ("m", pa.int64())])
    return rows.mapInArrow(run, kinds)


def _batch(frames: list[pd.DataFrame], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pd.concat(frames), schema=schema, preserve_index=False)


def _verify(survivors: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """Exact similarity of the surviving pairs: ``cid, v1, added`` (rows linked) and a spanning forest, by id ``u, v`` and by class ``p, q``."""
    wanted = survivors.select("cid", "_h").distinct()
    texts = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))
    texts = prefiltered(texts, F.xxhash64("_d", "_h"), wanted, F.xxhash64("cid", "_h"))

    @F.pandas_udf("binary")
    def hashed(column: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in column], dtype=object)

    sets = texts.select(F.col("_d").alias("cid"), "_h", hashed("text").alias("set"))
    rows = (survivors.join(sets, ["cid", "_h"]).repartition(*_TASK).sortWithinPartitions(*_TASK, "no"))
    schema = pa.schema([("cid", pa.int64()), ("v1", pa.int64()), ("added", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("p", pa.int64()), ("q", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pd.DataFrame] = []
        for group in runs(batches, _TASK):
            group = group.drop_duplicates("no")  # a document row may be there twice
            place = {n: k for k, n in enumerate(group["no"])}
            sets = [np.frombuffer(s, dtype=np.uint64) for s in group["set"]]
            size, many = np.array([len(s) for s in sets]), group["m"].to_numpy()
            pair = np.zeros((len(sets), len(sets)), dtype=bool)
            for k, partners in enumerate(group["partners"]):
                pair[k, [place[p] for p in partners]] = True
            shared = shared_counts(sets)
            hit = pair & (shared >= threshold * (size[:, None] + size - shared) - 1e-9)
            if not hit.any():
                continue
            added = hit @ many + many @ hit
            forest, every = Forest(len(sets)), np.arange(len(sets))
            forest.link(hit, every, every)
            own, root = forest.edges()
            some = np.flatnonzero(added)
            cid, v1 = group["cid"].to_numpy(), group["v1"].to_numpy()
            out.append(pd.DataFrame({"cid": np.concatenate((cid[some], cid[own])), "v1": np.concatenate((v1[some], v1[own])),
                                     "added": np.concatenate((added[some], np.zeros(len(own), dtype=np.int64))),
                                     "u": cid[np.concatenate((some, own))], "v": cid[np.concatenate((some, root))],
                                     "p": v1[np.concatenate((some, own))], "q": v1[np.concatenate((some, root))]}))
            if sum(map(len, out)) >= 5_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return rows.mapInArrow(run, "cid long, v1 long, added long, u long, v long, p long, q long")


def _links(docs: DataFrame, threshold: float, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sketches, their classes of equal sets, and the links between classes (``_verify``)."""
    sketches = staged(_sketch(docs, id_col, text_col, words), "jaccard-sketches")
    classes = staged(sketches.where("n > 0").groupBy("v1", "v2").agg(F.min(F.struct("_d", "_h")).alias("r"), F.count("*").alias("m"), F.first("sig").alias("sig"))
                     .select("v1", "v2", F.col("r._d").alias("cid"), F.col("r._h").alias("_h"), "m", "sig"), "jaccard-classes")
    survivors = staged(_prune(_candidates(classes), classes, threshold), "jaccard-survivors")
    return sketches, classes, staged(_verify(survivors, docs, id_col, text_col, words, threshold), "jaccard-links")


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(_d, _h, n_links, class_id)``; ``_d`` and ``_h`` are ``doc_key``.

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is ``threshold`` or more. ``n_links`` counts the other rows linked to a
    row, copies included; ``class_id`` is the smallest id that links reach. Words are
    lower-cased runs of letters and digits; a text of fewer than ``words`` words is one
    shingle.

    Documents with equal sets are one class, merged map-side, and never compared.
    Classes meet in buckets, in tasks of at most 2 * ``BLOCK`` members whatever the
    bucket's size; what leaves a task is a row per member, never the pairs. Whole texts
    are read twice: for the sketches, and, for classes with a surviving partner, for
    the exact sets.

    Null and empty texts, and texts without a word, link with nothing. Rows that agree
    in id and text are copies of each other; documents that share an id but not the
    text count as linked in ``class_id``. A null id is ``NULL_ID``, the smallest. Empty
    table: empty result. No other column is read.
    """
    sketches, classes, found = _links(docs, threshold, words, id_col, text_col)
    degree = found.groupBy("cid", "v1").agg(F.sum("added").alias("added"))
    root = components(found.select("u", "v"), "jaccard-components")
    result = staged(classes.select("v1", "v2", "cid", "m").join(degree, ["cid", "v1"], "left").join(root, F.col("cid") == F.col("node"), "left")
                    .select("v1", "v2", (F.col("m") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("class_id")), "jaccard-result")
    return (sketches.where("n > 0").select("_d", "_h", "v1", "v2").join(result, ["v1", "v2"]).select("_d", "_h", "n_links", "class_id")
            .unionByName(sketches.where("n = 0").select("_d", "_h", F.lit(0).cast("long").alias("n_links"), F.col("_d").alias("class_id"))))


def public(joined: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` of ``join``'s result."""
    back = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return joined.select(back("_d").alias("doc_id"), back("class_id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the least (id, hash of the text).

    Groups go by texts alone, linked as in ``join``: rows that share an id, or have none, but not
    the text belong together only if links connect their texts. A null id is the smallest. Of
    rows that agree in id and text one stays. Null texts and texts without a word all stay.
    """
    with scratch(docs.sparkSession) as keep:
        sketches, classes, found = _links(docs, THRESHOLD, WORDS, id_col, text_col)
        root = staged(components(found.select(F.col("p").alias("u"), F.col("q").alias("v")), "jaccard-groups"), "jaccard-roots")
        grouped = staged(classes.select("v1", "v2", F.struct("cid", "_h").alias("o")).join(root, F.col("v1") == F.col("node"), "left")
                         .select("v1", "v2", "o", F.coalesce("root", "v1").alias("group")), "jaccard-grouped")
        stays = staged(grouped.groupBy("group").agg(F.min("o").alias("stays")), "jaccard-stay")
        last = staged(grouped.join(stays, "group").select("v1", "v2", F.col("stays.cid").alias("kd"), F.col("stays._h").alias("kh")), "jaccard-keep")
        rows = sketches.where("n > 0").select("_d", "_h", "v1", "v2").join(last, ["v1", "v2"])
        rows = rows.groupBy("_d", "_h").agg(F.count("*").alias("n"), F.max((F.col("_d") == F.col("kd")) & (F.col("_h") == F.col("kh"))).alias("stays"))
        touched = keep(rows.where("n > 1 or not stays").select("_d", "_h", "stays"), "jaccard-touched")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    d, h = doc_key(id_col, text_col)
    marks = marked(docs.select(F.struct(*cols).alias("_row"), d, h), F.xxhash64("_d", "_h"), touched, F.xxhash64("_d", "_h"))
    maybe = marks.where("_maybe").select("_row", "_d", "_h")
    one = maybe.join(touched.where("stays"), ["_d", "_h"], "left_semi").groupBy("_d", "_h").agg(F.first("_row").alias("_row"))
    rest = maybe.join(touched, ["_d", "_h"], "left_anti")
    return marks.where("not _maybe").select("_row").unionByName(rest.select("_row")).unionByName(one.select("_row")).select("_row.*")
