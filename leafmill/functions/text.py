"""Text expressions: keys for lookup, narrowing, HTML to plain text, timestamps, redaction."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = "・･-‐‑‒–—―−"
KATAKANA_FIRST, KATAKANA_LAST, KANA_SHIFT = 0x30A1, 0x30FA, 0x60
VU_KATAKANA, U_HIRAGANA = "ヴ", "う"


def ascii_upper(text: Column) -> Column:
    return F.translate(text, LOWER, UPPER)


def ascii_key(text: Column) -> Column:
    """Lookup key of ASCII text: no white space, hyphens or dots of separation, A-Z upper."""
    return ascii_upper(F.regexp_replace(F.trim(text), r"[\s\-]", ""))


def _kana(text: str) -> str:
    return text.translate({k: k - KANA_SHIFT for k in range(KATAKANA_FIRST, KATAKANA_LAST + 1)})


def reader_key(text: str | None) -> str:
    """NFKC, kana folded to hiragana, no separators or dashes, ASCII upper; other letters keep their case."""
    folded = _kana(unicodedata.normalize("NFKC", text or "").strip())
    kept = (c for c in folded if c not in SEPARATORS and not unicodedata.category(c).startswith("Z") and unicodedata.category(c) != "Pd")
    return "".join(kept).translate(str.maketrans(LOWER, UPPER))


def author_key(text: str | None) -> str:
    """NFKC, kana folded (vu to u), no separators, punctuation or format characters; case stays."""
    folded = _kana(unicodedata.normalize("NFKC", text or "").replace(VU_KATAKANA, U_HIRAGANA))
    return "".join(c for c in folded if unicodedata.category(c)[0] not in "ZP" and unicodedata.category(c) != "Cf")


def _vectorized(f, text: Column) -> Column:
    def mapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f(t) if isinstance(t, str) else None)

    return F.pandas_udf(mapped, "string")(text)


def normalized_reader(text: Column) -> Column:
    return _vectorized(reader_key, text)


def normalized_author(text: Column) -> Column:
    return _vectorized(author_key, text)


def unescaped(text: Column) -> Column:
    """Character references resolved."""
    return _vectorized(html.unescape, text)


def narrowed(text: Column) -> Column:
    """Full-width ASCII, the ideographic space and the minus sign as ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　−"
    return F.translate(text, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " -")


def without_tags(markup: Column) -> Column:
    """Markup as text: line breaks for <br>, no tags, at most one empty line together, trimmed; references stay."""
    broken = F.regexp_replace(markup, r"(?i)<br\s*/?>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(broken, r"<[^>]*>", ""), r"\n{3,}", "\n\n"))


#: References that pages use, in the order in which they are replaced: the ampersand's last, so that nothing is resolved twice.
PAGE_REFERENCES = [("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")]


def plain_text(markup: Column, references: list[tuple[str, str]] | None = None) -> Column:
    """without_tags with all character references resolved, or with the given ones only."""
    text = without_tags(markup)
    if references is None:
        return unescaped(text)
    for name, shown in references:
        text = F.replace(text, F.lit(name), F.lit(shown))
    return text


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def hrefs(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(r'href="([^"]*)"'), 1)


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def milliseconds(stamp: Column) -> Column:
    """hh:mm:ss.f, mm:ss.f or digits (already milliseconds) as a long; a comma is a decimal point; anything else is null."""
    clean = F.replace(F.trim(stamp), F.lit(","), F.lit("."))
    parts = F.split(clean, ":")
    n = F.size(parts)
    whole = lambda k: F.element_at(parts, k).try_cast("long")
    seconds = (F.element_at(parts, -1).try_cast("decimal(18,6)") * 1000).cast("long")
    timed = F.when(n == 3, (whole(1) * 60 + whole(2)) * 60_000 + seconds).when(n == 2, whole(1) * 60_000 + seconds)
    shaped = clean.rlike(r"^(\d+:){1,2}\d+(\.\d+)?$")
    return F.when(clean.rlike(r"^\d+$"), clean.try_cast("long")).when(shaped, timed)


def redacted(path: Column, root: str, name: str) -> Column:
    """A path below root as <name>/rest."""
    return F.when(F.startswith(path, F.lit(root + "/")), F.concat(F.lit(f"<{name}>"), F.substr(path, F.lit(len(root) + 1)))).otherwise(path)


def safe_url(url: Column) -> Column:
    """Whether a link may be followed: http or https with a host, or mailto."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+") | url.rlike(r"(?i)^mailto:.+"), F.lit(False))


def split_values(text: Column) -> Column:
    """Distinct non-empty values between separators, in their order."""
    return F.array_distinct(F.filter(F.split(text, r"[\s,;、，・/／]+"), lambda v: v != ""))
