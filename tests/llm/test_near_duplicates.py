"""Jaccard join and line dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from helpers import documents, odd_rows, sentence
from pyspark.sql import functions as F

from touchline.llm import common as C
from touchline.llm import jaccard_join as J
from touchline.llm import line_dedup as D
from touchline.llm.common import NULL_ID, components


def edited(rnd, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rnd.randrange(len(words))] = rnd.choice(["xx", "yy", "zz"]) + str(rnd.randint(0, 99))
    return " ".join(words)


def corpus(rnd, n):
    base = [sentence(rnd, rnd.choice([3, 8, 40, 80, 200])) for _ in range(n // 4)]
    return [(i, edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 4, 8])), "en", "s") for i in range(n)]


class Roots(dict):
    def __missing__(self, k):
        return k

    def find(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def shingle_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute_join(rows, t=0.8):
    ids = [NULL_ID if r[0] is None else r[0] for r in rows]
    sets, root, degree = [shingle_set(r[1]) for r in rows], Roots(), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                degree[i] += 1
                degree[j] += 1
                root.join(ids[i], ids[j])
    return sorted((i, root.find(i), n) for i, n in zip(ids, degree))


def joined(df):
    return sorted((r["_d"], r["class_id"], r["n_links"]) for r in df.collect())


def test_join(spark, monkeypatch):
    rows = corpus(random.Random(1), 300)
    assert joined(J.join(documents(spark, rows))) == brute_join(rows)


def test_join_by_blocks(spark, monkeypatch):
    """Buckets larger than a block give the same links."""
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "COLUMNS", 16)
    rnd = random.Random(2)
    text = sentence(rnd, 120)
    rows = [(i, edited(rnd, text, i % 4), "en", "s") for i in range(90)] + [(200 + i, text, "en", "s") for i in range(9)]
    assert joined(J.join(documents(spark, rows))) == brute_join(rows)


def test_join_odd_rows(spark):
    rows = [r for r in odd_rows(random.Random(3)) if r[0] != 7]
    assert joined(J.join(documents(spark, rows, clash=True))) == brute_join(rows)
    assert J.join(documents(spark, [])).count() == 0
    assert joined(J.join(documents(spark, [(1, None, None, None), (2, "", None, None)]))) == [(1, 1, 0), (2, 2, 0)]


def test_one_of_each_group_stays(spark):
    rows = corpus(random.Random(4), 200)
    docs = documents(spark, rows, clash=True)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, root, _ in brute_join(rows) if i == root)


def test_one_row_stays_whatever_the_ids(spark):
    """Null and repeated ids: one of the equal and near rows stays, other texts with these ids as well."""
    rnd = random.Random(6)
    x, y, z = (sentence(rnd, 200) for _ in range(3))
    near = lambda t, w: t.rsplit(" ", 1)[0] + " " + w
    rows = [(i, t, "en", "s") for i, t in ((None, x), (None, x), (None, near(x, "xx")), (None, y), (3, z), (3, z), (3, near(z, "zz")), (3, "other text"), (4, None), (4, None), (5, ""), (2, near(x, "q")))]
    got = [(r["doc_id"], r["text"]) for r in J.keep_one(documents(spark, rows, clash=True)).collect()]
    assert len(got) == len(set(got)) + 1  # the two rows without a text
    first = {t: i for i, t in got}
    assert len(got) == 7 and sum(t in first for t in (x, near(x, "xx"))) == 1 and near(x, "q") not in first
    assert first[y] is None and first["other text"] == 3 and sum(t in first for t in (z, near(z, "zz"))) == 1


def test_sketches():
    assert (J.shingles("A b, c-d e!") == J.shingles("a B c d   E")).all() and len(J.shingles("a b c")) == 1
    assert not len(J.shingles(None)) and not len(J.shingles(" .,! "))
    rnd = random.Random(5)
    for _ in range(50):
        text = sentence(rnd, rnd.randint(0, 60))
        assert len(J.shingles(text)) == len(shingle_set(text))
    a, b = J.shingles(sentence(rnd, 3000)), J.shingles(sentence(rnd, 3000))
    near = np.unique(np.concatenate((a, b[:600])))
    assert abs((J.minhash(a) == J.minhash(near)).mean() - len(a) / len(near)) < 0.15


def test_pruning_keeps_what_can_reach():
    least = J.least_matches()
    n = J.BANDS * J.ROWS
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**32, n, dtype=np.uint32)
    near = np.where(rng.random((2000, n)) < 0.8, base, rng.integers(0, 2**32, (2000, n), dtype=np.uint32))
    far = np.where(rng.random((2000, n)) < 0.3, base, rng.integers(0, 2**32, (2000, n), dtype=np.uint32))
    assert len(J.surviving(base[None], near, least)[1]) == 2000
    assert len(J.surviving(base[None], far, least)[1]) < 20


# ---- lines ----

def normal(line):
    line = line.lower().translate({ord(c): " " for c in D.SPACES} | {ord(c): None for c in D.PUNCTUATION})
    return re.split(" +", line.strip(" "))


def simhash(words):
    words = [w for w in words if len(w) > D.LIGHT]
    h = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], dtype=np.uint64)
    bits = (h[:, None] >> np.arange(D.BITS, dtype=np.uint64)) & np.uint64(1)
    return sum(1 << b for b in range(D.BITS) if 2 * int(bits[:, b].sum()) > len(words))


def edit_distance(a, b):
    row = np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b])
    for i, c in enumerate(a):
        best = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(np.concatenate(([i + 1], best)) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return row[-1]


def brute_lines(rows):
    """Texts after dedup; rows with distinct ids."""
    first, sims, root, rnd = {}, {}, Roots(), random.Random(0)
    lines = [(NULL_ID if r[0] is None else r[0], k, " ".join(normal(x))) for r in rows if r[1] is not None for k, x in enumerate(r[1].split("\n"))]
    for i, k, x in sorted(lines):
        if x:
            first.setdefault(x, (i, k))
            heavy = any(len(w) > D.LIGHT for w in x.split(" "))
            sims.setdefault(x, simhash(x.split(" ")) if heavy else rnd.getrandbits(D.BITS))
    texts = list(first)
    for i, x in enumerate(texts):
        for y in texts[:i]:
            if (sims[x] ^ sims[y]).bit_count() <= D.DISTANCE and edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                root.join(first[x], first[y])
    keep = {x: root.find(first[x]) for x in first}
    out = []
    for i, text, *_ in rows:
        parts = None if text is None else [x for k, x in enumerate(text.split("\n")) if not (n := " ".join(normal(x))) or keep[n] == (NULL_ID if i is None else i, k)]
        out.append((str(i), None if parts is None else "\n".join(parts)))
    return sorted(out, key=str)


def texts_of(df):
    return sorted(((str(r["doc_id"]), r["text"]) for r in df.collect()), key=str)


def lined(rnd, n):
    base = [sentence(rnd, rnd.choice([1, 2, 6, 20, 60])) for _ in range(30)]
    make = lambda: rnd.choice(["", "  ", "--", rnd.choice(base), rnd.choice(base).upper() + "!", edited(rnd, rnd.choice(base), 1), sentence(rnd, 12)])
    return [(i, "\n".join(make() for _ in range(rnd.randint(0, 9))), "en", "s") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rows = lined(random.Random(seed), 120)
    assert texts_of(D.dedup(documents(spark, rows))) == brute_lines(rows)


def test_near_copies_of_one_line(spark):
    rnd = random.Random(3)
    line = sentence(rnd, 300)
    rows = [(i, edited(rnd, line, i % 3) + "\n" + sentence(rnd, 9), "en", "s") for i in range(120)]
    got = D.dedup(documents(spark, rows), count_as="lost")
    assert texts_of(got) == brute_lines(rows)
    assert got.agg(F.sum("lost")).first()[0] > 60


def test_line_sketch_counts_exactly(spark):
    """Packed lanes and the wide counters of long lines give the plain SimHash."""
    rnd = random.Random(4)
    rows = [(n, sentence(rnd, n), "en", "s") for n in (1, 2, 3, 255, 256, 510, 511, 512, 513, 5_000)] + [(9_999, "same " * 3_000, "en", "s"), (9_998, "same of to " * 600, "en", "s")]
    got = {r["_d"]: r["sim"] for r in D.sketch(documents(spark, rows)).collect()}
    assert got == {i: simhash(normal(t)) for i, t, *_ in rows}


def test_lines_odd_rows(spark):
    rows = [(1, None, "en", "s1"), (2, "", "en", "s1"), (3, "   \n\t ", None, "s2"), (4, "12 ?! 7\n12 7", "en", None), (None, "12 7\nx", "en", None),
            (5, sentence(random.Random(5), 20_000), "en", "s"), (6, "\n\n!!\nx", "en", "s"), (8, "\U0001F600 中文 naïve ß\n\U0001F600 中文 naïve ß", "en", "s1")]
    docs = documents(spark, rows, clash=True)
    got = D.dedup(docs)
    assert got.columns == docs.columns and texts_of(got) == brute_lines(rows)
    twice = D.dedup(documents(spark, [(5, "a b\nc d", "en", "s")] * 2 + [(6, "c d", "en", "s")]))
    assert texts_of(twice) == [("5", "a b\nc d"), ("5", "a b\nc d"), ("6", "")]
    assert D.dedup(documents(spark, [])).count() == 0


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)] + [(7, 7)]
    root = Roots()
    for a, b in edges:
        root.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root.find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- lines against plain edit similarity, without any SimHash ----

def lost(spark, texts, **how):
    """Which of the texts, a document each, lose their line."""
    got = D.dedup(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), count_as="lost", **how)
    return {r["doc_id"] for r in got.where("lost > 0").collect()}


def alike(x, y):
    return edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9


def test_short_words_have_weight(spark):
    """Near copies of lines of words of one to three characters meet; lines of other short words do not share a SimHash."""
    rnd, letters = random.Random(7), "abcdefg12文"
    base = [[rnd.choice(letters) + rnd.choice(letters) * rnd.randint(0, 2) for _ in range(160)] for _ in range(12)]
    copies = [" ".join(x[:80] + ["zz9"] + x[81:]) for x in base]
    base = [" ".join(x) for x in base]
    assert all(alike(x, y) for x, y in zip(base, copies)) and max(map(len, " ".join(base + copies).split(" "))) <= 3
    assert len(lost(spark, base + copies) & set(range(12, 24))) >= 8
    sims = [r["sim"] for r in D.sketch(documents(spark, [(1, "total 12 45", "en", "s"), (2, "total 13 77", "en", "s")])).collect()]
    assert sims[0] != sims[1]


def test_cuts_find_one_changed_word(spark):
    """All similar lines that differ in one word, or by one more, at any length; SimHash alone loses most of the short ones."""
    rnd = random.Random(8)
    base = [sentence(rnd, n).split(" ") for n in (4, 5, 6, 7, 9, 10, 11, 15, 20, 21, 30, 50) for _ in range(4)]
    copies = []
    for i, w in enumerate(base):
        k = rnd.randrange(len(w))
        copies.append(w[:k] + ["zz9"] * (i % 4 < 2) + w[k + (i % 4 != 1):])  # replaced, added or left out
    base, copies = [" ".join(w) for w in base], [" ".join(w) for w in copies]
    want = {len(base) + i for i, (x, y) in enumerate(zip(base, copies)) if alike(x, y)}
    assert len(want) > 40
    assert lost(spark, base + copies, cuts=True) == want
    assert len(lost(spark, base + copies)) < len(want) / 2


def test_cuts_link_only_similar_lines(spark):
    rnd = random.Random(9)
    texts = [" ".join([*rnd.choice((["total", "of", "the"], ["page"], [], ["copyright", "notice", "holders"])), *(rnd.choice(["12", "345", "a", "alran", "betel"]) for _ in range(rnd.randint(1, 4)))]) for _ in range(120)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], clash=True)
    first = {}
    for t in texts:
        first.setdefault(" ".join(normal(t)), len(first))
    links = D.repeated_lines(docs, cuts=True)
    known, root = list(first), Roots()
    for i, x in enumerate(known):
        for y in known[:i]:
            if alike(x, y):
                root.join(first[x], first[y])
    groups = len({root.find(i) for i in first.values()})
    stay = len(texts) - links.count()
    assert groups <= stay < len(first)
    assert D.dedup(documents(spark, []), cuts=True).count() == 0


def test_lengths_refute_before_texts_are_read(spark, monkeypatch):
    """Lines that one word rules have its SimHash; of those not linked, only pairs of like lengths are listed and read."""
    rnd = random.Random(8)
    rows = [(i, " ".join(["the"] * 40 + sentence(rnd, 4 ** (i % 3 + 1) // 2).split(" ")), "en", "s") for i in range(30)]
    listed, staged = {}, D.staged

    def counted(df, label):
        out = staged(df, label)
        listed[label] = out.collect() if label == "lines-loose" else None
        return out

    monkeypatch.setattr(D, "staged", counted)
    assert texts_of(D.dedup(documents(spark, rows))) == brute_lines(rows)
    assert "lines-loose" in listed
    line = {xxhash.xxh64_intdigest(" ".join(normal(t)).encode(), 42): " ".join(normal(t)) for _, t, *_ in rows}
    lengths = [sorted(len(line[v % 2**64]) for v in (r["x"], r["y"])) for r in listed["lines-loose"]]
    assert all(long - short <= 0.2 * long + 1e-9 for short, long in lengths)


def test_components_with_hubs(spark, monkeypatch):
    """Nodes of many edges, whose minimum is broadcast, and others, whose minimum is joined."""
    monkeypatch.setattr(C, "HUB", 5)
    rnd = random.Random(10)
    edges = [(500, 600 + i) for i in range(40)] + [(600 + i, 700 + i % 7) for i in range(0, 40, 3)] + [(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(60)] + [(90, 500)]
    root = Roots()
    for a, b in edges:
        root.join(a, b)
    got = [(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert sorted(got) == sorted((x, root.find(x)) for x in {x for e in edges for x in e if e[0] != e[1]})


def test_texts_of_lines_are_staged_once(spark, monkeypatch):
    """Each line's text is written once, whatever is told of distinct lines; cuts are made once, and copies make no more of what they share."""
    rnd, held, written = random.Random(11), {}, C._written

    def counted(df, label, owner):
        out = written(df, label, owner)
        held.setdefault(label, []).append((out.columns, out.count()))
        return out

    monkeypatch.setattr(C, "_written", counted)
    texts = ["\n".join(sentence(rnd, 30) for _ in range(4)) for _ in range(20)]
    D.dedup(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).count()
    assert sum(n for tables in held.values() for columns, n in tables if "line" in columns) == 80
    held.clear()
    line = sentence(rnd, 20)
    texts = [line, line.replace(line.split(" ")[9], "zz9")] * 30 + texts
    D.dedup(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), cuts=True).count()
    assert len(held["lines-cuts"]) == 1 and 2 <= held["lines-cut-held"][0][1] <= 16


def test_near_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Texts of near copies that no lead connects: each with its nearest, then only what is apart still."""
    rnd, listed, staged = random.Random(12), {}, D.staged

    def counted(df, label):
        out = staged(df, label)
        listed[label] = out.count()
        return out

    monkeypatch.setattr(D, "staged", counted)
    line = sentence(rnd, 40)
    others = [sum(1 << b for b in range(D.BITS) if not any(start <= b < start + bits for start, bits in table)) for table in D.TABLES]  # the lead of one bucket each
    rows = [(a, sim, "".join(rnd.choice("0123456789") for _ in line)) for a, sim in enumerate(others)] + [(100 + i, 0, edited(rnd, line, 1)) for i in range(40)]
    links = D.similar_lines(spark.createDataFrame([(a, sim, len(t)) for a, sim, t in rows], "a long, sim long, long int"), spark.createDataFrame([(a, t) for a, _, t in rows], "a long, line string"))
    root = {r["node"]: r["root"] for r in components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))).collect()}
    assert root == {100 + i: 100 for i in range(40)}
    assert listed["lines-loose"] == 780 and listed["lines-nearest"] + listed["lines-rest"] <= 40


def test_similar_lines_are_those_of_the_edit_distance(spark):
    """Accepted by pieces, refuted by what remains, or compared whole: the same pairs as by the plain edit distance."""
    rnd = random.Random(13)
    texts = ["a", "e", "aeiou", "tea eat", "uoie uoie aaa", "x", "中文 naïve ß", "中文 naive ß", "\U0001F600 \U0001F600 a b", "\U0001F600 b a b"]
    for n in (1, 3, 8, 9, 17, 40):
        w = sentence(rnd, n).split(" ")
        k = rnd.randrange(n)
        texts += [" ".join(x) for x in (w, w[:k] + w[k + 1:] + ["zz"], [*w, "zz9"], w[:k] + ["zz9", "y"] + w[k:], w[::-1], ["zz9"] * (n // 4) + w[n // 4:])]
        texts += ["".join(rnd.choice("bcd") if c != " " and rnd.random() < p else c for c in " ".join(w)) for p in (0.1, 0.18, 0.22, 0.3)]
        texts += [" ".join(w).replace(" ", "", n // 6), "".join(c for c in " ".join(w) if c not in D.FREQUENT or rnd.random() < 0.6)]
    texts = [" ".join(t.split()) for t in texts]
    pairs = [(x, y) for x in range(len(texts)) for y in range(x) if texts[x] and texts[y]]
    lines = spark.createDataFrame(list(enumerate(texts)), "a long, line string")
    want = {(x, y) for x, y in pairs if alike(texts[x], texts[y])}
    found = lambda df: {(r["x"], r["y"]) for r in df.collect()}
    listed = spark.createDataFrame(pairs, "x long, y long")
    left = found(D._not_refuted(listed, lines))
    assert found(D._similar(listed, lines)) == want and len(want) > 30
    assert want <= left and len(left) < len(pairs) / 2


def test_whole_texts_are_read_for_few_pairs(spark, monkeypatch):
    """Pairs of lines that one word rules are refuted by what remains of them."""
    rnd = random.Random(14)
    rows = [(i, "the " * 30 + " ".join("".join(rnd.choice("bcdfgklmnprsvz") for _ in range(8)) for _ in range(20)), "en", "s") for i in range(14)]
    listed, staged = {}, D.staged

    def counted(df, label):
        out = staged(df, label)
        listed[label] = out.count()
        return out

    monkeypatch.setattr(D, "staged", counted)
    assert texts_of(D.dedup(documents(spark, rows))) == brute_lines(rows)
    assert listed["lines-rest"] > 40 and listed["lines-not-refuted"] < 5


def test_roots_of_lines_take_few_shuffles(spark):
    """All that are connected have one root, whatever the shape; each round has few jobs of the driver."""
    rnd = random.Random(15)
    some = lambda: rnd.getrandbits(63) - 2**62
    chain, ring, hub = ([some() for _ in range(n)] for n in (60, 7, 300))
    edges = [*zip(chain, chain[1:]), *zip(ring, ring[1:] + ring[:1]), *((hub[0], v) for v in hub[1:]), (hub[5], ring[0]), (chain[0], chain[0]), (some(), some())]
    edges += [(5, 5)] + [(y, x) for x, y in edges[:20]]
    root = Roots()
    for x, y in edges:
        root.join(x, y)
    frame = lambda edges: spark.createDataFrame(edges, "x long, y long")
    got = [(r["node"], r["root"]) for r in D._roots(frame(edges)).collect()]
    nodes = {v for x, y in edges for v in (x, y) if x != y}
    assert len(got) == len(nodes) and {n for n, _ in got} == nodes
    assert len({(r, root.find(n)) for n, r in got}) == len({r for _, r in got}) == len({root.find(n) for n in nodes})
    assert all(root.find(r) == root.find(n) for n, r in got)
    assert D._roots(frame([])).count() == 0 and D._roots(frame([(3, 3)])).count() == 0
    spark.sparkContext.setJobGroup("roots of lines", "")
    D._roots(frame([(hub[0], v) for v in hub[1:]]))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("roots of lines"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 24, jobs


def test_white_space_is_normalised(spark):
    texts = ["a\tb", "a b", " a  b ", "a \t \x0b b", "a - b", "a , . b", "\x0ca\r b.", "A B!", "a\n\n \n  b", "“a” — b", "ab", "a  ", "  ", "--  --"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = sorted((r["_d"], r["pos"], r["line"]) for r in D.lines_of(documents(spark, rows)).collect())
    assert got == [(i, k, line) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if (line := " ".join(normal(x)))]
