"""Secret scanning with corpus-wide ownership frequency.

Text patterns alone cannot tell a live credential from the example that half of
all tutorials carry. The corpus can: a candidate's hash is counted by distinct
repositories and distinct owners, and a value that many owners share is an
example, while one that stays with its owner looks live.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import doc_key, staged

#: Fixed patterns; in ``assign`` letters of the name may be in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is a match of [0-9a-f]+ that is long enough
#: Added by the method: opaque values without a name before them, if one owner alone has them.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: A value that so many distinct owners have, at least, is an example; one with a single owner looks live.
SHARED_OWNERS = 3
#: Bits a character from which an opaque value looks random.
OPAQUE_BITS = 3.5

_NAMES = ("password", "passwd", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` of a whole text by start, then kind; ends exclusive, in code points."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def opaque_spans(text: str, base: Sequence[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Random-looking values of 24 or more characters with both letters and digits that touch no base span."""
    out = []
    starts = [s for _, s, _, _ in base]
    reach = list(accumulate((e for _, _, e, _ in base), max))  # the furthest end of the base spans up to each

    def touched(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and reach[before - 1] > start

    for m in OPAQUE.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not touched(m.start(), m.end()):
            n = len(v)
            if -sum(k / n * math.log2(k / n) for k in Counter(v).values()) >= OPAQUE_BITS:
                out.append(("opaque", m.start(), m.end(), v))
    return out


_FOUND = "array<struct<kind:string,start:int,stop:int,value:string>>"


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``found``: the base and opaque candidates of each whole text (null: empty)."""

    @F.pandas_udf(_FOUND)
    def scan(texts: pd.Series) -> pd.Series:
        def one(text):
            base = base_spans(text or "")
            return [dict(zip(("kind", "start", "stop", "value"), s, strict=True)) for s in base + opaque_spans(text or "", base)]
        return pd.Series([one(t) for t in texts])

    return docs.withColumn("found", scan(F.col(text_col)))


def ownership(candidates: DataFrame) -> DataFrame:
    """``(v1, v2, repository, owner)`` rows -> ``(v1, v2, repositories, owners)``, the distinct counts of each hash.

    Repeats of a hash within a repository are merged map-side first, so a value that
    a third of all documents carry is a few rows per task before anything is shuffled.
    """
    each = candidates.groupBy("v1", "v2", "owner", "repository").agg(F.lit(1).alias("one"))
    return (each.groupBy("v1", "v2", "owner").agg(F.count("*").alias("n"))
            .groupBy("v1", "v2").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners")))


def scan(docs: DataFrame, owner: Column, repository: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``(doc_id, spans)``, spans an array of
    ``(kind, start, stop, class, repositories, owners)`` by start, then kind.

    class: ``example`` where ``SHARED_OWNERS`` distinct owners or more have the value,
    ``live`` where one owner alone has it, else ``shared``. Base spans (assign, access,
    hex) are always kept. Opaque candidates are kept only where they are live.

    Texts are read once; candidates go to a staged table with 128-bit hashes of their
    values in place of the values, are counted, and get their counts back by a join of
    two staged tables, which Spark splits where one hash is very frequent. Then a
    document's spans meet by document. Documents without candidates take no part in it
    until the last join.

    Null text is empty text. A null owner or repository counts as one more, nameless
    one. Rows that agree in id and text are one document. Empty table: empty result.
    """
    key = doc_key(id_col, text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), *key, F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.col(text_col).alias("text"))
    found = staged(find(slim, "text").drop("text").select(
        "doc_id", "_d", "_h", "owner", "repository",
        F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
                                                F.xxhash64(s["value"]).alias("v1"), F.xxhash64(F.concat(F.lit("\u0001"), s["value"])).alias("v2"))).alias("found")), "secrets")
    each = found.select("_d", "_h", "owner", "repository", F.explode("found").alias("f")).select("_d", "_h", "owner", "repository", "f.*")
    counts = staged(ownership(each), "secret-owners")
    kind = F.when(F.col("owners") >= SHARED_OWNERS, "example").when(F.col("owners") == 1, "live").otherwise("shared")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = (each.select("_d", "_h", "kind", "start", "stop", "v1", "v2").join(counts, ["v1", "v2"]).withColumn("class", kind)
             .where((F.col("kind") != "opaque") | (F.col("class") == "live"))
             .groupBy("_d", "_h").agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "stop", "class", "repositories", "owners"))).alias("spans")))
    kept = "kind string, start int, stop int, class string, repositories long, owners long"
    shaped = F.transform("spans", lambda s: F.struct(*[s[f.split()[0]].alias(f.split()[0]) for f in kept.split(", ")]))
    with_any = found.where(F.size("found") > 0).select("doc_id", "_d", "_h").join(spans.withColumn("spans", shaped), ["_d", "_h"], "left")
    none = found.where(F.size("found") == 0).select("doc_id")
    empty = F.array().cast(f"array<struct<{kept.replace(' ', ':')}>>".replace(",:", ","))
    return (with_any.select("doc_id", F.coalesce("spans", empty).alias("spans"))
            .unionByName(none.select("doc_id", empty.alias("spans"))))


def digest(scanned: DataFrame) -> DataFrame:
    """The counts and joined spans of ``scan``'s result, one row per document row."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def of(spans, name, value):
        return F.filter(spans, lambda s: s[name] == value)

    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    return scanned.select("doc_id", *[F.size(of("spans", "kind", k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                          F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
                          *[F.size(of("spans", "class", c)).cast("long").alias(f"n_{c}") for c in ("live", "shared", "example")])
