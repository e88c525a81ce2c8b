"""Mixing: against plain loops, and the cases of the docstring."""

import hashlib
import random
import re

from helpers import documents, odd_rows, sentence

from touchline.llm import source_mix


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(size), list(sources), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    out = {}
    for s in sources:
        times = int(target[s] // total[s]) if total[s] else 0
        rest, groups = target[s] - times * total[s], {}
        for i, r in enumerate(rows):
            if r[3] == s:
                h = int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16)
                groups.setdefault(h, []).append(i)
        before = 0
        for h in sorted(groups):
            words = sum(size[i] for i in groups[h])
            more = 2 * before + words <= 2 * rest and (before + words <= rest or before <= rest)
            for i in groups[h]:
                out[i] = (rows[i][0], size[i], total[s], round(target[s], 6), (times + (more and before < rest)) * size[i])
            before += words
    return sorted((tuple(str(x) for x in v) for v in out.values()))


def rows_of(df):
    return sorted(tuple(str(x) for x in (r["doc_id"], r["mix_size"], r["mix_source_size"], round(r["mix_target"], 6), r["mix_taken"])) for r in df.collect())


def test_against_loops(spark):
    rnd = random.Random(3)
    rows = [(i, sentence(rnd, rnd.randint(0, 90)), "en", rnd.choice(["a", "a", "a", "b", "Z", "é", None])) for i in range(400)]
    got = source_mix.mix(documents(spark, rows))
    assert rows_of(got) == brute(rows)
    for s in {r[3] for r in rows}:
        part = [r for r in got.collect() if r["source"] == s]
        assert abs(sum(r["mix_taken"] for r in part) - part[0]["mix_target"]) <= 90


def test_odd_rows(spark):
    rows = odd_rows(random.Random(4))
    got = source_mix.mix(documents(spark, rows, clash=True))
    assert rows_of(got) == brute(rows)
    assert set(documents(spark, rows, clash=True).columns) <= set(got.columns)
    assert all(r["mix_taken"] <= 2 * r["mix_size"] for r in got.collect())


def test_empty(spark):
    assert source_mix.mix(documents(spark, [])).count() == 0
    assert source_mix.mix(documents(spark, [(1, None, None, None)])).first()["mix_taken"] == 0


def test_budgets_nest(spark):
    rnd = random.Random(5)
    docs = documents(spark, [(i, sentence(rnd, 30), "en", "abc"[i % 3]) for i in range(200)])
    less, more = ({(r["doc_id"]): r["mix_copies"] for r in source_mix.mix(docs, share=s).collect()} for s in (0.4, 0.6))
    assert all(more[k] >= n for k, n in less.items())


def test_dotted_names_pass_through(spark):
    docs = documents(spark, [(1, "a b", "en", "s")]).selectExpr("*", "7 as `a.b`")
    assert source_mix.mix(docs).first()["a.b"] == 7
