"""Small tables with the awkward rows that every operator must stand."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": ["the", "th", "er", "on", "an", "ing", "nd"], "de": ["sch", "ein", "ung", "der", "ver", "ich"], "fr": ["eau", "que", "les", "tion", "oi", "eux"]}


def sentence(draw: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    """Clean texts, copies, near copies, shared passages, and null, empty, blank, repetitive and long texts."""
    draw = random.Random(5)
    out = []
    for k in range(60):
        lang = ("en", "de", "fr")[k % 3]
        out.append([k, ".\n".join(sentence(draw, lang, 12) for _ in range(draw.randint(3, 14))), lang, "hot" if k % 3 == 0 else f"s{k % 4}"])
    passage = sentence(draw, "en", 110)
    for k in range(3, 50, 6):
        out[k][1] += "\n" + passage + "\n" + sentence(draw, "en", 5)
    for k in range(60, 90):
        out.append([k, out[7][1], "de", "hot"])
    for k in range(90, 100):
        out.append([k, out[8][1].replace(" ", f" w{k} ", 1), "fr", "hot"])
    out.append([100, None, "en", "s1"])
    out.append([101, "", "en", "s1"])
    out.append([102, " \n\t ", None, None])
    out.append([103, "word " * 3000, "en", "s2"])
    out.append([104, "a" * 5000, "en", "s2"])
    out.append([105, sentence(draw, "fr", 9000), "fr", "s3"])
    out.append([106, "One two", None, "s3"])
    out.append([None, sentence(draw, "de", 40), "de", None])
    out.append([5, out[5][1], "fr", "hot"])
    out.append([107, "12345 67 !!! ***", "en", "s1"])
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(5, F.col("n_chars"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
