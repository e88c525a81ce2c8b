"""Rank-order profiles: held-out accuracy, and the cases of the docstring."""

import random
import zlib

from helpers import documents, odd_rows
from pyspark.sql import functions as F

from touchline.llm import lang_profiles as L
from touchline.llm import queries


def slow_counts(text):
    counts, word = {}, ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            w = f"_{word}_"
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] != "_":
                        counts[w[i:i + n]] = counts.get(w[i:i + n], 0) + 1
            word = ""
    return counts


def packed(gram):
    out = 0
    for c in (gram + "\0\0")[:3]:
        out = out << L.CHAR_BITS | (L.BORDER if c == "_" else ord(c))
    return out


def test_counts_against_loops():
    rnd = random.Random(1)
    for text in ["", "a", "ab  cd", "Über-Maß 12 naïve", "中文 x", None, "İI ı"] + ["".join(rnd.choice("aB é1-\n") for _ in range(rnd.randint(0, 60))) for _ in range(200)]:
        grams, counts = L.gram_counts(text)
        assert dict(zip(grams.tolist(), counts.tolist())) == {packed(g): n for g, n in slow_counts(text).items()}


def test_distance_against_loops():
    profiles = {"x": [packed(g) for g in ("a", "b", "ab")], "y": [packed(g) for g in ("b", "_b", "c")]}
    places = L.Places(profiles)
    mine = sorted(slow_counts("bab b").items(), key=lambda kv: (-kv[1], packed(kv[0])))
    moved = {k: sum(abs(i - p.index(packed(g))) if packed(g) in p else L.PROFILE for i, (g, _) in enumerate(mine)) for k, p in profiles.items()}
    best = min(sorted(moved), key=moved.get)
    assert L.nearest("bab b", places) == (best, 1 - moved[best] / (L.PROFILE * len(mine)))
    assert L.nearest("a", L.Places({"q": [packed("a")], "p": [packed("a")]}))[0] == "p"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_rank_order_profiles(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert held[1] > 200 and held[0] > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())


def test_odd_rows(spark):
    docs = documents(spark, odd_rows(random.Random(2)), clash=True).drop("lang_pred")
    named = L.identify(docs, L.fit(docs)).collect()
    assert len(named) == docs.count()
    for r in named:
        assert 0 <= r["lang_score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))


def test_empty(spark):
    docs = documents(spark, [])
    assert L.fit(docs) == {} and L.identify(docs, {}).count() == 0
    assert L.identify(documents(spark, [(1, "abc", None, None)]), {}).first()["lang_pred"] == "und"


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "qqq www" if zlib.crc32(str(i).encode()) % 4 == 2 else "aaa bbb", "en", None) for i in range(40)]
    assert packed("q") not in L.fit(documents(spark, rows))["en"]
