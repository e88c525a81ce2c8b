"""Fixtures of the corpus operator tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("al", "be", "ca", "do", "er", "fu", "gi", "ho") for b in ("ran", "tel", "mis", "pok", "dun", "vas", "lim", "sor")]
#: Columns that clash with names the operators use inside.
CLASH = "_p string, _d long, _h long, _row string, size long, target string, n long, a long, v string, lang_pred string, found string, line string, pos int, rule string"


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def documents(spark: SparkSession, rows: list[tuple], clash: bool = False) -> DataFrame:
    """``(doc_id, text, lang, source)`` rows, if asked with clashing columns, all null."""
    kinds = "doc_id long, text string, lang string, source string"
    if not clash:
        return spark.createDataFrame(rows, kinds)
    extra = CLASH.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * extra) for r in rows], f"{kinds}, {CLASH}")


def odd_rows(rnd: random.Random) -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    long = sentence(rnd, 30_000)
    rows = [(1, None, "en", "s1"), (2, "", "en", "s1"), (3, "   \n\t ", None, "s2"), (4, "12 ?! 7", "en", None), (None, sentence(rnd, 40), "en", "s1"),
            (5, long, "en", "s2"), (5, long, "en", "s2"), (6, long, "de", None), (7, "a", None, None), (7, "b", None, None), (None, None, None, None),
            (8, "\U0001F600 中文 naïve ß İ \x00 \x1c", "en", "s1")]
    return rows + [(100 + i, sentence(rnd, 60), "en", f"s{i % 3}") for i in range(20)]
