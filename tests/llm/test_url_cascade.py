"""Bloom filter cascades are exact on their universe; verdicts against plain rules."""

import random

import numpy as np
from pyspark.sql import functions as F

from touchline.llm import url_cascade as U


def test_cascade_is_exact():
    rnd = np.random.default_rng(5)
    for listed_share in (0.0, 0.001, 0.1, 0.5, 0.9, 1.0):
        a, b = rnd.integers(0, 2**63, (2, 20_000)).astype(np.uint64)
        listed = rnd.random(20_000) < listed_share
        levels = U.build_cascade(a, b, listed)
        assert (U.in_cascade(levels, a, b) == listed).all()
        if 0 < listed_share < 0.2:  # far smaller than the universe
            assert sum(len(x.bits) for x in levels) < 20_000 * 16 / 4


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(r), len(r.split("/", 1)[0]), r) for _, r in rules
            for h, p in [(r[:r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None


URLS = ["http://a.net/x", "https://B.Example.NET/en/1?x#y", "http://example.net/enx", "http://example.net/en/", "http://notexample.com/de/1", "http://www.example.com/de/1#t", "ftp://example.org/fr/",
        "http://org/fr/1", "http://org/en", "http://net", "http://net/", "http://x.net?en/", "no scheme", "", None, "http://", "://a.org/fr/x", "http://a..net//", "http://example.com/fr/http://b.net/",
        "http://É.Example.net/en/", "http://user@host.net:80/a", "http://a.net/x", "http://plain.test/" + "p" * 50_000]


def judged(spark, rows, rules=U.RULES, shards=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean, rule string, listed string, _keys string")
    return U.judge(pages, F.col("bad"), rules, shards=shards).collect()


def test_rules_and_list(spark):
    rnd = random.Random(2)
    urls = URLS + [f"http://h{rnd.randint(0, 40)}.{rnd.choice(['example.net', 'example.com', 'other.test', 'org'])}/{rnd.choice(['en', 'de', 'fr'])}/{rnd.randint(0, 9)}" for _ in range(600)]
    rows = [(i, u, rnd.random() < 0.2 if i % 7 else None, None, None, None) for i, u in enumerate(urls)]
    bad = {plain(u, U.RULES)[:2] for _, u, b, *_ in rows if b}
    action = {r: v for v, r in U.RULES}
    for shards in (1, 3):
        got = {r["page_id"]: r for r in judged(spark, rows, shards=shards)}
        assert len(got) == len(rows)
        for i, u, *_ in rows:
            host, path, rule = plain(u, U.RULES)
            r = got[i]
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
            assert r["listed"] == ((host, path) in bad)
            assert r["verdict"] == (action[rule] if rule else "block" if (host, path) in bad else "allow")


def test_blocks_of_filters(spark, monkeypatch):
    """With filters beyond one block, several passes give the same answers."""
    rows = [(i, f"http://h{i}.test/{i % 5}", i % 3 == 0, None, None, None) for i in range(500)]
    whole = judged(spark, rows, shards=5)
    monkeypatch.setattr(U, "BLOCK_BYTES", 40)
    assert sorted(judged(spark, rows, shards=5)) == sorted(whole)
    assert all(r["listed"] == (r["page_id"] % 3 == 0) for r in whole)


def test_empty_and_null_ids(spark):
    assert judged(spark, []) == []
    got = judged(spark, [(None, None, None, None, None, None)] * 2)
    assert [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in got] == [(None, "", None, "allow")] * 2
    assert [r["verdict"] for r in judged(spark, [(1, "http://a.net/", True, None, None, None)], rules=())] == ["block"]
