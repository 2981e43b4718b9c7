"""Local glyphs: what they show by evidence from aligned texts, and one resolution a code."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = re.compile(r"<[hz]([0-9A-F]{4})>|(.)", re.DOTALL)


def observed(decoded: DataFrame, by: list[str]) -> DataFrame:
    """(by, code, n): occurrences of local glyphs, hidden ones too."""
    return decoded.filter("kind = 'glyph' and issue is null").groupBy(*by, "code").agg(F.count("*").alias("n"))


def _aligned(raw: str | None, shown: str | None) -> list[dict]:
    tokens = [m[1].lower() if m[1] else m[2] for m in PLACEHOLDER.finditer(re.sub(r"[\r\n\t]", " ", raw or ""))]
    chars = list(re.sub(r"[\r\n\t]", " ", shown or ""))
    votes = []
    for tag, a, b, c, d in difflib.SequenceMatcher(a=tokens, b=chars, autojunk=False).get_opcodes():
        codes, there = [t for t in tokens[a:b] if t != " "], [x for x in chars[c:d] if x != " "]
        if tag != "equal" and codes and all(len(t) == 4 for t in codes) and len(codes) == len(there):
            votes += [{"code": t, "char": x} for t, x in zip(codes, there, strict=True)]
    return votes


def votes(pairs: DataFrame, raw: str, shown: str) -> DataFrame:
    """(code, char, n): a run of placeholders alone that stands against as many characters votes for each of them."""

    def mapped(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_aligned(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    each = pairs.select(F.explode(F.pandas_udf(mapped, "array<struct<code:string,char:string>>")(raw, shown)).alias("v"))
    return each.groupBy("v.code", "v.char").agg(F.count("*").alias("n"))


def resolution(mapped: Column, entry_backed: Column, image: Column, bitmap: Column, blank: Column, code: Column) -> Column:
    """How a reader shows a glyph, by priority."""
    return (
        F.when(mapped.isNotNull() & (mapped != ""), "unicode").when(entry_backed, "entry_backed").when(image, "image").when(bitmap & blank, "formatting_helper")
        .when(bitmap, "bitmap").when(F.startswith(code, F.lit("b")), "formatting_helper").otherwise("unresolved")
    )
