"""Lookup keys of a query in the spellings that indexes use, and predicates over names, displays and bodies."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import reader_key

# Fixed values.
SMALL_KANA, FULL_KANA = "ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮ", "あいうえおつやゆよわアイウエオツヤユヨワ"
SYMBOLS, SYMBOL_CELLS = "-~/+&.,:;()", "−￣／＋＆．，：；（）"
WIDE = 0xFEE0
TEXT_TYPES = "TEXT|CHAR|CLOB"
TEXT_NAMES = ["body", "title", "titlejis", "f_title", "f_title_ss", "f_html", "f_plane", "f_keyword", "f_contents", "f_midashi", "f_midashi_hyoki", "f_midashi_kana"]
HEX_LINES = "[0-9A-Fa-f]{8,16}|[0-9A-Fa-f]{6,16}(?:\\n[0-9A-Fa-f]{6,16})+"
SHORT_CODE = "[A-Za-z0-9+/]{6,24}={0,2}"


@cache
def _cell(char: str) -> bytes | None:
    """The two-byte cell of a character; none if the set has none."""
    try:
        raw = char.encode("iso2022_jp")
    except UnicodeEncodeError:
        return None
    return raw[3:-3] if raw.startswith(b"\x1b$B") and len(raw) == 8 else None


def _joined(parts: list[bytes | None]) -> bytes | None:
    return None if None in parts else b"".join(parts)


def _spellings(text: str) -> list[bytes | None]:
    """A text as single bytes where it is ASCII, as cells with the symbols of the set, and as full-width cells."""
    folded = unicodedata.normalize("NFKC", text).strip()
    wide = lambda c: "　" if c == " " else chr(ord(c) + WIDE) if "!" <= c <= "~" else c
    symbols = dict(zip(SYMBOLS, SYMBOL_CELLS, strict=True))
    return [
        _joined([c.encode() if "!" <= c <= "~" else _cell(c) for c in folded if c != " "]),
        _joined([_cell(symbols.get(c) or wide(c)) for c in folded]),
        _joined([_cell(wide(c)) for c in folded]),
    ]


def key_candidates(query: str, backward: bool = False) -> list[bytes]:
    """Distinct key bytes under which an index may have a query, in the order in which they are tried; reversed for suffix keys."""
    raw = query.strip()
    small = str.maketrans(SMALL_KANA, FULL_KANA)
    tried = [raw, reader_key(query), raw.translate(small), reader_key(query).translate(small)]
    found = [s for value in tried if value for s in _spellings(value[::-1] if backward else value)]
    return list(dict.fromkeys(s for s in found if s))


def matches_candidates(key: Column, query: str, phase: str = "exact") -> Column:
    """Whether key bytes are (exact) or begin with (forward, or backward on suffix keys) any spelling of a query."""
    found = F.lit(False)
    for candidate in key_candidates(query, phase == "backward"):
        found = found | ((key == F.lit(candidate)) if phase == "exact" else F.startswith(key, F.lit(candidate)))
    return found


def selected(rows: DataFrame, name: str, ids: list[str], prefix: str = "") -> DataFrame:
    """rows whose name is one of the ids, without regard to case or to a prefix that either may have; all rows if there are no ids."""
    bare = lambda s: s.upper().removeprefix(prefix.upper())
    upper = F.upper(name)
    own = F.when(F.startswith(upper, F.lit(prefix.upper())), F.substr(upper, F.lit(len(prefix) + 1))).otherwise(upper)
    return rows.filter(own.isin(sorted({bare(i) for i in ids}))) if ids else rows


def useless_body(body: Column) -> Column:
    """Whether a body says nothing: empty but for section and media tags, or only hexadecimal lines or one short code."""
    compact = F.regexp_replace(body, r"^\s+|\s+$", "")
    content = F.regexp_replace(F.regexp_replace(compact, "<section:[0-9A-Fa-f]{4}>|<media:[0-9A-Fa-f]+>", ""), r"^\s+|\s+$", "")
    return F.coalesce((content == "") | compact.rlike(f"^(?:{HEX_LINES})$") | content.rlike(f"^(?:{HEX_LINES}|{SHORT_CODE})$"), F.lit(True))


def informative_display(display: Column) -> Column:
    """Whether a display tells its glyph from others: not empty, no white space or control character, not one ASCII character."""
    return F.coalesce((display != "") & ~display.rlike(r"[\s\x00-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]") & ~display.rlike(r"^[\x00-\x7f]$"), F.lit(False))


def _needs_fallback(display: str) -> bool:
    for c in display:
        name = unicodedata.name(c, "")
        if ord(c) > 0xFFFF or unicodedata.combining(c) or unicodedata.category(c)[0] in "SM":
            return True
        if "WITH" in name and any(script in name for script in ("LATIN", "GREEK", "CYRILLIC")):
            return True
    return False


def search_fallback_missing(display: Column, fallback: Column, n: Column) -> Column:
    """Whether a used glyph's display can't be typed as it is and has no text to search by: marks, symbols, letters with marks, supplementary characters."""

    def mapped(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _needs_fallback(v) if isinstance(v, str) else False).astype(bool)

    asked = (n > 0) & (F.coalesce(display, F.lit("")) != "") & (F.coalesce(fallback, F.lit("")) == "")
    return F.coalesce(asked & F.pandas_udf(mapped, "boolean")(display), F.lit(False))


def text_column(name: Column, declared: Column) -> Column:
    """Whether a database column holds text, by its declared type or else its name."""
    return F.coalesce(F.upper(declared).rlike(TEXT_TYPES), F.lit(False)) | F.coalesce(F.lower(name).isin(TEXT_NAMES), F.lit(False))


def valid_pointer(block: Column) -> Column:
    """Whether a pointer leads anywhere: its block isn't null or 0."""
    return F.coalesce(block > 0, F.lit(False))


def by_number(columns: list[str]) -> list[Column]:
    """Sort keys of text columns as SQLite casts them to integers: their leading digits, or 0."""
    return [F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0)) for c in columns]
