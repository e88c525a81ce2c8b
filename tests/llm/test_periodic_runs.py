"""Periodic runs: against a search over all periods, and the cases of the docstring."""

import hashlib
import random
import time
import zlib

import pytest
from helpers import SF, documents, odd_rows, sentence
from pyspark.sql import functions as F

from touchline.llm import periodic_runs as P
from touchline.llm import queries


def brute(words, least=6, exponent=4):
    """For each period the maximal stretches that keep it, unless a smaller period holds there too."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(least, exponent * q):
                found.setdefault((start, i - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def looped(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def row(doc_id, words):
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (str(doc_id), len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def rows_of(df):
    return sorted((tuple([str(r["doc_id"]), *r[1:]]) for r in df.collect()), key=str)


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (1, 2), (5, 3)])
def test_words_against_all_periods(least, exponent):
    rnd = random.Random(least)
    for _ in range(600):
        words = []
        while len(words) < rnd.randint(0, 90):
            unit = [rnd.choice("abcde"[: rnd.randint(1, 5)]).encode() for _ in range(rnd.randint(1, 9))]
            words += unit * rnd.randint(1, 7)
            words += unit[: rnd.randint(0, len(unit))]
        assert P.word_runs(words, least, exponent) == brute(words, least, exponent)


def test_spans_only_leave_out_what_no_run_holds():
    rnd = random.Random(1)
    for _ in range(300):
        words = [b"w%d" % min(int(rnd.expovariate(0.2)), 30) for _ in range(rnd.randint(1, 300))]
        unit = words[: rnd.randint(1, 20)]
        words += unit * rnd.randint(1, 6) + words[:40]
        assert P.word_runs(words) == brute(words)


def test_long_texts():
    """A third of a million words that all are in runs, in n log n steps."""
    unit = [b"%d" % i for i in range(1000)]
    begun = time.time()
    assert P.word_runs([b"x"] * 100_000) == [(0, 100_000, 1)]
    assert P.word_runs(unit * 100 + [b"y"] + unit * 5) == [(0, 100_000, 1000), (100_001, 5000, 1000)]
    assert time.time() - begun < 120
    fib = [b"a", b"a b"]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + b" " + fib[-2])
    assert P.word_runs(fib[-1].split()) == []  # no fourth power in it
    assert len(P.word_runs(fib[10].split(), 2, 2)) == len(brute(fib[10].split(), 2, 2))


def test_table(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join([sentence(rnd, 5)] + [sentence(rnd, rnd.randint(1, 6))] * rnd.randint(1, 8) + [sentence(rnd, 3)]), "en", "s") for i in range(100)]
    rows += [r for r in odd_rows(rnd) if len(r[1] or "") < 10_000] + [(500, "a b\x0b" * 9 + " a\x85b \x00 \x00", "en", "s")]
    docs = documents(spark, rows, clash=True).withColumn("a.b", F.lit(1)).withColumn("run", F.lit("x"))
    found = P.find(P.looped(docs))
    assert found.columns == [*docs.columns, "run_list", "run_collapsed"]
    assert rows_of(P.digests(found)) == sorted((row(r[0], looped(r[0], r[1])) for r in rows), key=str)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 3


def test_empty(spark):
    assert P.digests(P.find(P.looped(documents(spark, [])))).count() == 0
    one = P.digests(P.find(P.looped(documents(spark, [(None, None, None, None)])))).first()
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(one) == (None, 0, None, None, None, None, nothing, nothing)
    with pytest.raises(ValueError):
        P.find(documents(spark, []), exponent=1)


def test_query(spark):
    got = queries.QUERIES["op13_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {str(i): looped(i, t) for i, t in docs}
    small = {i for i, w in want.items() if len(w) < 800}
    assert len(small) > 100
    assert [r for r in rows_of(got) if r[0] in small] == sorted((row(i, want[i]) for i in small), key=str)
    assert got.count() == len(docs)
