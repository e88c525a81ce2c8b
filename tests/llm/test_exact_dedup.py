"""Exact dedup: against plain dictionaries, with weak hashes so that texts collide, and the cases of the docstring."""

import hashlib
import random
import string

import pytest
from helpers import SF, documents, odd_rows, sentence
from pyspark.sql import functions as F

from touchline.llm import exact_dedup, queries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, largest):
    """(id, keep id, size, sha256) of each row, and the number of groups."""
    members = {}
    for r in rows:
        members.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    pick = max if largest else min
    out = []
    for text, ids in members.items():
        keep = pick(ids, key=lambda i: (i is not None, i or 0))
        out += [(str(i), str(keep), len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out), len(members)


def rows_of(df):
    return sorted((str(r["doc_id"]), str(r["dup_keep_id"]), r["dup_size"], r["dup_sha256"]) for r in df.collect())


def cases(seed):
    rnd = random.Random(seed)
    texts = [sentence(rnd, rnd.randint(1, 12)) for _ in range(30)]
    rows = [(i, rnd.choice((str.upper, str.title, str))(rnd.choice(texts)), "en", "s") for i in range(200)]
    rows += [(1000 + i, "the very same text", "en", "s") for i in range(150)]
    rows += [(2000, "École", "fr", "s"), (2001, "école", "fr", "s"), (2002, "éCOLE", "fr", "s"), (2003, "a ", "en", "s"), (2004, "a", "en", "s"), (2004, "A", "en", "s")]
    return rows + odd_rows(rnd)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("bits", [128, 4])
def test_against_dictionaries(spark, keep, bits):
    rows = cases(bits)
    weak = (lambda t: F.substring(F.md5(t), 1, 1)) if bits == 4 else exact_dedup.content_hash
    got = exact_dedup.groups(documents(spark, rows), keep=keep, content=weak)
    want, n = brute(rows, keep == "largest")
    assert rows_of(got) == want
    kept = got.where("dup_kept").collect()
    assert len(kept) == n and all(r["doc_id"] == r["dup_keep_id"] for r in kept)


def test_unique_keeps_columns(spark):
    rows = cases(5)
    docs = documents(spark, rows, clash=True).withColumn("a.b", F.lit(1)).withColumn("_n", F.lit("x")).withColumn("_t", F.lit(2))
    got = exact_dedup.unique(docs)
    assert got.columns == docs.columns
    assert got.count() == brute(rows, False)[1]
    assert {r["a.b"] for r in got.collect()} == {1}


def test_empty(spark):
    assert exact_dedup.groups(documents(spark, [])).count() == 0
    one = exact_dedup.groups(documents(spark, [(None, None, None, None)])).first()
    assert (one["dup_keep_id"], one["dup_size"], one["dup_kept"]) == (None, 1, True)
    with pytest.raises(ValueError):
        exact_dedup.groups(documents(spark, []), keep="any")


def test_no_python_and_hot_groups_by_broadcast(spark):
    docs = documents(spark, [(i, "hot" if i % 3 else f"t{i}", "en", "s") for i in range(300)])
    plan = exact_dedup.groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


def test_query(spark):
    got = queries.QUERIES["op11_exact_dedup"](spark, SF)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got.collect()) == brute(docs, True)[0]
