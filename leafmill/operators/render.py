"""Entries as text and HTML: four profiles of HTML, five policies for local glyphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import escaped

from .streams import glyph_text
from .windows import clipped_depth

PROFILES = ["friendly", "semantic", "reader", "debug"]
POLICIES = ["unicode_preferred", "bitmap_preferred", "bitmap_only", "placeholder", "raw_code"]
ELEMENTS = {"bold": "b", "italic": "i", "sub": "sub", "sup": "sup", "em": "em"}
UNKNOWN = "□"
HELPER = "formatting_helper"


def glyph_display(policy: str) -> Column:
    """A local glyph's text by policy; a formatting helper shows only as a raw code."""
    raw = F.concat(F.lit("<h"), F.upper("code"), F.lit(">"))
    if policy == "raw_code":
        return raw
    shown = F.coalesce(F.nullif("resolved", F.lit("")), F.lit(UNKNOWN)) if policy in ("unicode_preferred", "bitmap_preferred") else F.lit(UNKNOWN)
    return F.when(F.col("glyph_status") == HELPER, "").otherwise(shown)


def glyph_by_mode(code: Column, resolved: Column, mode: str) -> Column:
    """A glyph in extracted text: its mapping, else nothing (drop), a placeholder, or one for codes below B0 alone (h-placeholder)."""
    known = F.nullif(resolved, F.lit(""))
    if mode == "drop":
        return F.coalesce(known, F.lit(""))
    if mode == "h-placeholder":
        return F.coalesce(known, F.when(F.substring(code, 1, 2) < "b0", glyph_text(code, F.lit(None).cast("string"))).otherwise(""))
    return glyph_text(code, resolved)


def _rows(decoded: DataFrame, keys: list[str], glyphs: DataFrame | None) -> DataFrame:
    """Visible spans with their line, whether they stand in the head, and how their glyph is resolved (code, status by package)."""
    order = Window.partitionBy(*keys).orderBy("span")
    head = F.when((F.col("tag") == "head") & (F.col("role") == "start"), 1).when((F.col("tag") == "head") & (F.col("role") == "end"), -1).otherwise(0)
    rows = clipped_depth(decoded, keys, ["span"], head, "in_head")
    rows = rows.withColumn("line", F.coalesce(F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if glyphs is not None:
        rows = rows.join(glyphs.select("package_id", "code", F.col("status").alias("glyph_status")), ["package_id", "code"], "left")
    else:
        rows = rows.withColumn("glyph_status", F.lit(None).cast("string"))
    kinds = ["text", "ascii", "glyph", "control", "media_ref", "unknown_control", "break"]
    return rows.filter(~F.col("hidden") & F.col("kind").isin(kinds))


def _inline(profile: str, policy: str, keys: list[str]) -> Column:
    """The HTML of one span."""
    plain = F.col("kind").isin("text", "ascii")
    order = Window.partitionBy(*keys).orderBy("span")
    letters = escaped(F.coalesce("normalized", F.lit("")))
    if profile == "semantic":  # one element around each run of letters
        edge = lambda step: F.coalesce(step(F.when(plain, 1).otherwise(0)).over(order), F.lit(0)) == 0
        letters = F.concat(F.when(edge(F.lag), '<span class="inline text">').otherwise(""), letters, F.when(edge(F.lead), "</span>").otherwise(""))
    shown, resource = escaped(glyph_display("raw_code" if profile == "debug" else policy)), F.concat(F.lit("glyph-"), F.col("code"))
    known = F.coalesce(F.col("resolved") != "", F.lit(False))
    wrap = lambda attrs, inner: F.concat(F.lit("<span "), attrs, F.lit(">"), inner, F.lit("</span>"))
    if profile == "semantic":
        glyph = wrap(F.lit('class="inline glyph" data-kind="glyph"'), shown)
    elif profile == "debug":
        glyph = wrap(F.concat(F.lit('class="glyph-debug" data-code="'), F.col("code"), F.lit('" data-resource-id="'), resource, F.lit('" data-status="'), F.coalesce("glyph_status", F.lit("")), F.lit('"')), shown)
    else:
        glyph = F.when(known, wrap(F.lit('class="glyph"'), shown)).otherwise(f'<span class="glyph unresolved">{UNKNOWN}</span>')
        if policy in ("bitmap_preferred", "bitmap_only"):
            held = F.when(known, shown).otherwise(UNKNOWN) if policy == "bitmap_preferred" else F.lit(UNKNOWN)
            glyph = wrap(F.concat(F.lit('class="glyph resource" data-resource-id="'), resource, F.lit('"')), held)
        if profile == "reader":
            glyph = F.when(known, wrap(F.lit('class="reader-glyph"'), shown)).otherwise(glyph)
        glyph = F.when(F.col("glyph_status") == HELPER, '<span class="glyph helper" aria-hidden="true"></span>').otherwise(glyph)
    prefix = {"semantic": "inline inline-", "reader": "reader-"}.get(profile, "")
    tag = F.lit(None).cast("string")
    for name in ["halfwidth", "literal", "url", "link", "private", *ELEMENTS]:
        element = ELEMENTS.get(name)
        if name in ("halfwidth", "private"):
            begin = end = ""
        elif element and not prefix:
            begin, end = f"<{element}>", f"</{element}>"
        else:
            begin, end = f'<{element or "span"} class="{prefix}{name}">', f'</{element or "span"}>'
        tag = F.when(F.col("tag") == name, F.when(F.col("role") == "start", begin).otherwise(end)).otherwise(tag)
    media = F.concat(F.lit(f'<span class="{prefix}media-ref" data-ref="'), F.coalesce("payload", F.lit("")), F.lit('">[media]</span>'))
    unknown = F.concat(F.lit('<span class="control-debug" data-op="'), F.coalesce("op", F.lit("")), F.lit('"></span>')) if profile == "debug" else F.lit("")
    return (
        F.when(plain, letters).when(F.col("kind") == "glyph", glyph).when(F.col("kind") == "media_ref", media)
        .when(F.col("kind") == "unknown_control", unknown).when(F.col("kind") == "control", F.coalesce(tag, F.lit(""))).otherwise("")
    )


def html(decoded: DataFrame, keys: list[str], profile: str = "friendly", policy: str = "unicode_preferred", glyphs: DataFrame | None = None) -> DataFrame:
    """(keys, html): each entry as an article of blocks, a heading and a paragraph for each line; lines that show nothing are left out.

    glyphs: (package_id, code, status) of resolved glyphs, so that formatting helpers are known.
    """
    rows = _rows(decoded, keys, glyphs).withColumn("shown", _inline(profile, policy, keys)).filter("kind <> 'break'")
    parts = F.array_sort(F.collect_list(F.struct("span", "shown")))
    seen = F.col("kind").isin("text", "ascii", "glyph", "media_ref")
    lines = rows.groupBy(*keys, "line").agg(F.array_join(F.transform(parts, lambda p: p["shown"]), "").alias("body"), F.bool_or((F.col("in_head") > 0) & seen).alias("head"), F.bool_or(seen).alias("seen")).filter("seen")
    around = lambda before, after: F.concat(F.lit(before), F.col("body"), F.lit(after))
    if profile == "semantic":
        block = F.when(F.col("head"), around('<section class="block heading" data-kind="heading"><h3>', "</h3></section>")).otherwise(around('<section class="block paragraph" data-kind="paragraph">', "</section>"))
    elif profile == "reader":
        block = F.when(F.col("head"), around('<div class="reader-heading">', "</div>")).otherwise(around('<p class="reader-line">', "</p>"))
    else:
        extra = " debug-block" if profile == "debug" else ""
        block = F.when(F.col("head"), around(f'<h3 class="heading{extra}">', "</h3>")).otherwise(around(f'<p class="paragraph{extra}">', "</p>"))
    blocks = F.array_sort(F.collect_list(F.struct("line", block.alias("b"))))
    inner = F.array_join(F.transform(blocks, lambda x: x["b"]), "")
    return lines.groupBy(*keys).agg(F.concat(F.lit(f'<article class="entry profile-{profile}" data-render-profile="{profile}">'), inner, F.lit("</article>")).alias("html"))


def text(decoded: DataFrame, keys: list[str], policy: str = "unicode_preferred", glyphs: DataFrame | None = None) -> DataFrame:
    """(keys, text): the lines of each entry that show something, trimmed."""
    rows = _rows(decoded, keys, glyphs).filter(F.col("kind").isin("text", "ascii", "glyph", "media_ref"))
    shown = F.when(F.col("kind") == "glyph", glyph_display(policy)).when(F.col("kind") == "media_ref", "[media]").otherwise(F.coalesce("normalized", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("span", shown.alias("s"))))
    lines = rows.groupBy(*keys, "line").agg(F.trim(F.array_join(F.transform(parts, lambda p: p["s"]), "")).alias("body")).filter("body <> ''")
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n").alias("text"))
