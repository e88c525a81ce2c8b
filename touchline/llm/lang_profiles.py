"""Language identification by rank-order n-gram profiles and out-of-place distance.

A language's profile is the list of its most frequent character n-grams, most
frequent first. A document gets the same kind of list from its whole text; the
distance to a profile is the sum, over the document's n-grams, of how far each is
out of place (the profile's length where it is missing). The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a profile, of a language or a document.
PROFILE = 300
#: Labelled documents a language, about, that profiles are learnt from (a share by id hash).
FIT_DOCS = 1_000
#: An n-gram is of 1 to 3 characters, packed into an integer of 21 bits a character, so that numbers
#: are in code point order; 1 stands for a word's border.
CHAR_BITS, BORDER = 21, 1

_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Code point -> its lower case if it is a letter, else BORDER. Once a Python worker."""
    if not _TABLES:
        table = np.full(0x110000, BORDER, dtype=np.int64)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLES.append(table)
    return _TABLES


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text's words, ascending, and how often each occurs."""
    chars = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.concatenate(([BORDER], _tables()[0][chars], [BORDER]))
    c = c[np.concatenate(([True], (c[1:] != BORDER) | (c[:-1] != BORDER)))]
    letter = c != BORDER
    two = c[:-1] << CHAR_BITS | c[1:]
    grams = np.concatenate((c[letter] << 2 * CHAR_BITS, two << CHAR_BITS, (two[:-1] << CHAR_BITS | c[2:])[letter[1:-1]]))
    return np.unique(grams, return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties in code point order. grams ascend."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def fit_split(id_col: str = "doc_id") -> Column:
    """True for documents that profiles may be learnt from: crc32(id as text) mod 4 is not 2."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) != 2


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Language -> profile, learnt from ``FIT_DOCS`` documents a language, about, among those
    that ``fit_split`` allows and that have a text and a language (all of them where
    there are fewer).

    One narrow pass counts documents by language; the sample is the documents whose id
    hash lies below that language's share. N-grams are counted and summed by Spark;
    the driver gets a count and ``PROFILE`` n-grams a language. Empty table: no profiles.
    """
    rows = docs.where(fit_split(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    docs_of = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not docs_of:
        return {}
    cut = {lang: min(1.0, FIT_DOCS / n) for lang, n in docs_of.items()}
    share = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    within = share < F.element_at(F.create_map(*[F.lit(x) for kv in cut.items() for x in kv]), F.col("lang"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                each = [gram_counts(t) for t in texts]
                grams, which = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
                n = np.bincount(which, weights=np.concatenate([n for _, n in each]), minlength=len(grams))
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n.astype("int64")})

    grams = rows.where(within).select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    top = (grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
           .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
           .where(F.col("k") <= PROFILE))
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["k"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Places:
    """Where each n-gram stands in each profile, as one matrix; its last row stands for n-grams in none."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.at = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int32)
        for k, lang in enumerate(self.langs):
            self.at[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def of(self, grams: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return self.at[np.where(self.grams[i] == grams, i, len(self.grams))]


def nearest(text: str | None, places: Places) -> tuple[str, float]:
    """Language and score of one text; see ``identify``."""
    mine = ranked(*gram_counts(text))
    if not len(mine) or not places.langs:
        return "und", 0.0
    at = places.of(mine)
    moved = np.where(at < 0, PROFILE, np.abs(at - np.arange(len(mine))[:, None])).sum(axis=0)
    best = int(moved.argmin())
    return places.langs[best], 1.0 - int(moved[best]) / (PROFILE * len(mine))


def identify(docs: DataFrame, profiles: dict[str, list[int]], *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (string) and ``lang_score`` (double, 0 to 1: one less the mean
    displacement of the document's n-grams, as a share of the profile's length).

    A map over whole texts, nothing shuffled; profiles travel with the task (at most
    ``PROFILE`` n-grams a language). Null text, a text without a letter, or no
    profile at all: ``und`` with score 0. Ties go to the first language in code
    point order. Only the text is read; other columns pass through.
    """
    places = Places(profiles)

    @F.pandas_udf("lang_pred string, lang_score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nearest(t, places) for t in texts], columns=["lang_pred", "lang_score"])

    cols = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(cols, predict(F.col(f"`{text_col}`")).alias("_p")).select("_row.*", "_p.*")
