"""Periodic runs of words: maximal stretches that repeat their first words over and over.

Each text is one row of a map; nothing is shuffled. A text's words become the symbols
of a suffix automaton. Its suffix links form a tree, kept as a link-cut tree whose
preferred paths bear the position where their words ended last. Appending a word
accesses its prefix state: the path to the root is recoloured, and every old segment
met on the way tells that the last ``length`` words also ended ``distance`` words
earlier. A distance within the length is a square, and squares of one start and
distance at successive words grow into a run. All in n log n steps a text.

Before that, words that cannot be in any wanted run are cut out (``spans``); a run
never crosses such a word, so the rest is searched span by span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many times its period.
LEAST, EXPONENT = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text after which a batch of results leaves the task.
BATCH_BYTES = 16 << 20
#: Rounds of cutting words out; more would only save time.
ROUNDS = 8


def automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of the states (0 is the root), and the state of each prefix."""
    link, length, step = [-1], [0], [{}]
    prefix, last = [], 0
    for c in symbols:
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        prefix.append(cur)
        last = cur
    return link, length, prefix


class PathColours:
    """Link-cut tree over suffix links: ``access`` recolours a state's path to the root.

    Preferred paths are splay trees ordered by depth (``lo`` is nearer to the root); the
    colour of a path is kept at its splay tree's root. The automaton's root, state 0,
    stands for no node.
    """

    def __init__(self, link: list[int]):
        n = len(link)
        self.up = [max(p, 0) for p in link]
        self.lo, self.hi, self.colour = [0] * n, [0] * n, [-1] * n

    def _rotate(self, x: int) -> None:
        up, lo, hi = self.up, self.lo, self.hi
        p = up[x]
        g = up[p]
        if lo[p] == x:
            b = lo[p] = hi[x]
            hi[x] = p
        else:
            b = hi[p] = lo[x]
            lo[x] = p
        if b:
            up[b] = p
        up[p] = x
        up[x] = g
        if g:
            if lo[g] == p:
                lo[g] = x
            elif hi[g] == p:
                hi[g] = x

    def access(self, state: int, colour: int) -> Iterator[tuple[int, int]]:
        """(deepest state, old colour) of each old segment of the path, deepest first."""
        up, lo, hi, colours, rotate = self.up, self.lo, self.hi, self.colour, self._rotate
        x, below = state, 0
        while x:
            p = up[x]
            while p and (lo[p] == x or hi[p] == x):
                g = up[p]
                if g and (lo[g] == p or hi[g] == p):
                    colours[x] = colours[g]
                    rotate(p if (lo[g] == p) == (lo[p] == x) else x)
                else:
                    colours[x] = colours[p]
                rotate(x)
                p = up[x]
            old = colours[x]
            if old >= 0:
                yield x, old
            cut = hi[x]
            if cut:
                colours[cut] = old
            hi[x] = below
            below = x
            x = up[x]
        colours[below] = colour


def runs_of(symbols: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    link, length, prefix = automaton(symbols)
    tree = PathColours(link)
    end: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefix):
        for deepest, old in tree.access(state, i):
            period = i - old
            same = length[deepest]
            if same >= (exponent - 1) * period:
                end[i - same - period + 1, period] = i
    return sorted((s, e + 1 - s, q) for (s, q), e in end.items() if e + 1 - s >= max(least, exponent * q))


def spans(symbols: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Stretches outside of which no word is in a run.

    A run of ``exponent`` periods holds each of its words ``exponent`` times, and each three
    neighbouring words ``exponent - 1`` times (with period 1: ``least - 2`` times). Words
    that fail are cut out, then the same holds within each stretch that is left.
    """
    n = len(symbols)
    triples = min(exponent - 1, max(least, exponent) - 2)
    if n < max(least, exponent):
        return []
    if max(least, exponent) < 3 or triples < 2:
        return [(0, n)]
    alive = np.bincount(symbols)[symbols] >= exponent
    for _ in range(ROUNDS):
        at = np.flatnonzero(alive[:-2] & alive[1:-1] & alive[2:])
        if not len(at):
            return []
        key = np.cumsum(~alive)[at]
        for k in range(3):
            key = np.unique(key * (int(symbols.max()) + 1) + symbols[at + k], return_inverse=True)[1].astype(np.int64)
        often = at[np.bincount(key)[key] >= triples]
        now = np.zeros(n, dtype=bool)
        for k in range(3):
            now[often + k] = True
        if (now == alive).all():
            break
        alive = now
    edge = np.flatnonzero(np.diff(np.concatenate(([False], alive, [False])).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= max(least, exponent)]


def word_runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start and period."""
    if len(words) < max(least, exponent):
        return []
    symbols = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    return [(a + s, n, q) for a, b in spans(symbols, least, exponent) for s, n, q in runs_of(symbols[a:b].tolist(), least, exponent)]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if runs:
        depth = np.zeros(len(words) + 1, dtype=np.int64)
        for start, n, period in runs:
            depth[start + period] += 1
            depth[start + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return b" ".join(words)


RUNS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find(docs: DataFrame, *, text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``run_list`` (array of start, length, period: word numbers from 0, by start and period)
    and ``run_collapsed`` (binary: the text with each run cut to its first period, words joined by one space).

    Words are what blanks and the controls 9 to 13 separate. A run has a smallest period
    q, at least ``least`` and ``exponent`` * q words, and cannot be extended on either side.
    A text is searched whole, in one task; its automaton takes some 500 bytes for each
    word that may be in a run.

    Null, empty and blank texts: no runs, an empty collapsed text. Rows do not affect each
    other; repeated rows get the same result. Empty table: empty result. Other columns
    pass through whatever their names, unless they bear one of the two ``run_`` names.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    text_at = docs.columns.index(text_col)
    extra = [pa.field("run_list", RUNS_TYPE), pa.field("run_collapsed", pa.binary())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, short, held, first = [], [], 0, 0
            for row, text in enumerate(batch.column(text_at).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                runs = word_runs(words, least, exponent)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                short.append(collapse(words, runs))
                held += len(short[-1])
                if held >= BATCH_BYTES or row == batch.num_rows - 1:
                    part = batch.slice(first, row + 1 - first)
                    new = [pa.array(found, RUNS_TYPE), pa.array(short, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], schema=pa.schema([*part.schema, *extra]))
                    found, short, held, first = [], [], 0, row + 1

    # Numbered names inside: a name may hold dots, which mapInArrow would take as paths.
    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{name} {f.dataType.simpleString()}" for name, f in zip(names, docs.schema, strict=True))
    found = docs.toDF(*names).mapInArrow(task, f"{kinds}, run_list array<struct<start: bigint, length: bigint, period: bigint>>, run_collapsed binary")
    return found.toDF(*docs.columns, "run_list", "run_collapsed")


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every tenth text (by the CRC of its id) made periodic from some word on.

    With h the CRC-32 of the decimal id, g = h div 10 and n words: where h % 10 = 0 and n > 0,
    each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). Such
    texts are joined by one space, all others are as they were. A null id changes nothing.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    chosen = docs.withColumn(text_col, F.struct(F.col(text_col).alias("whole"), (h / 10).cast("long").alias("g"),
                                                F.when(h % 10 == 0, F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))).alias("words")))
    n, g = F.size(f"{text_col}.words"), F.col(f"{text_col}.g")
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    words = F.col(f"{text_col}.words")
    loop = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.concat_ws(" ", F.slice(F.concat(F.slice(words, F.lit(1), a), loop), F.lit(1), n))
    return chosen.withColumn(text_col, F.when(n > 0, made).otherwise(F.col(f"{text_col}.whole")))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``find``'s result as one row of figures and digests a document; the longest run (ties: smallest start, then period)."""
    best = F.array_max(F.transform("run_list", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    line = F.transform("run_list", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    n, start, period = F.col("_b.n"), -F.col("_b.s"), -F.col("_b.q")
    return (found.select(id_col, "run_list", "run_collapsed", best.alias("_b"))
            .select(id_col, F.size("run_list").cast("long").alias("n_runs"), start.alias("start"), n.alias("length"), period.alias("period"),
                    F.expr("1000 * _b.n div -_b.q").alias("exponent_milli"), F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
                    F.sha2("run_collapsed", 256).alias("collapsed_sha256")))
