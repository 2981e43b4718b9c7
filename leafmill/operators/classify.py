"""Priority and rank classifiers as `when` chains over evidence columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import AUTHORING, CAPABILITY, rank_of

# Fixed values.
DENSE_STRIDE = 64
HELPER_SPACE = "b"
#: role -> column aliases that show it, in the order in which roles are tried.
SIDECAR_ROLES = [
    ("body", ["html", "f_html", "contents_html_box", "body", "text"]),
    ("media", ["blob", "data", "image", "sound"]),
    ("example", ["example", "sentence"]),
    ("search", ["keyword", "f_keyword", "key"]),
]


def body_shape(size: Column, markers: Column, index_targets: Column) -> Column:
    """dense if markers stand more than once in DENSE_STRIDE bytes (strictly), else by what else is there."""
    return (
        F.when(size == 0, "empty").when(markers * DENSE_STRIDE > size, "dense")
        .when((markers > 0) & (index_targets > 0), "indexed").when(markers > 0, "sliced").when(index_targets > 0, "index_only").otherwise("opaque")
    )


def glyph_bucket(n: Column, display: Column, image: Column, blank: Column, bitmap: Column, entry_backed: Column, code: Column) -> Column:
    """Where a glyph's display comes from, by priority; unused codes have buckets of their own."""
    mapped = display.isNotNull() & (display != "")
    helper = F.coalesce(blank, F.lit(False)) | (~bitmap & F.startswith(code, F.lit(HELPER_SPACE)))
    used = (
        F.when(mapped, "unicode_mapped").when(image, "image_backed").when(helper, "formatting_helper")
        .when(bitmap, "bitmap_backed").when(entry_backed, "renderer_entry_backed").otherwise("display_unresolved")
    )
    unused = F.when(mapped, "unused_mapping").when(image | bitmap, "unused_resource").otherwise("unused")
    return F.when(n > 0, used).otherwise(unused)


def glyph_flags(display: Column, fallback: Column, n: Column) -> Column:
    mapped = display.isNotNull() & (display != "") & (n > 0)
    return F.array_compact(F.array(F.when(mapped & F.coalesce(fallback == "", F.lit(True)), "search_fallback_missing"), F.when(mapped & (F.length(display) > 1), "multi_character")))


def glyph_summary(bucketed: DataFrame, by: str) -> DataFrame:
    """(by, status, unresolved, helper, occurrences): no if nothing shows, partial if something doesn't, else yes; n/a without glyphs."""
    n = lambda b: F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)).cast("long")
    made = bucketed.groupBy(by).agg(n("display_unresolved").alias("unresolved"), n("formatting_helper").alias("helper"), F.sum("n").cast("long").alias("occurrences"))
    status = F.when(F.col("occurrences") == 0, "n/a").when(F.col("unresolved") == 0, "yes").when(F.col("unresolved") == F.col("occurrences"), "no").otherwise("partial")
    return made.withColumn("status", status)


def validation_status(aligned: Column, db_text: Column, informative: Column, n: Column, image: Column, bitmap: Column) -> Column:
    return (
        F.when(aligned, "aligned").when(db_text, "db_text").when(~informative, "uninformative").when(n == 0, "unused")
        .when(image, "image").when(bitmap, "bitmap").otherwise("unresolved")
    )


def coverage_status(good: Column, total: Column) -> Column:
    return F.when(total == 0, "n/a").when(good == total, "yes").when(good == 0, "no").otherwise("partial")


def readiness(rows: DataFrame, capabilities: list[str]) -> DataFrame:
    """rows with blockers, the capabilities that aren't yes or n/a, and a colour: red if any is no, yellow if any is partial or unknown, else green."""
    bad = [F.when(~F.col(c).isin("yes", "n/a"), F.concat(F.lit(c + ":"), F.col(c))) for c in capabilities]
    worst = F.greatest(*[rank_of(F.col(c), CAPABILITY) for c in capabilities], F.lit(0))
    colour = F.when(worst >= CAPABILITY.index("no") + 1, "red").when(worst >= CAPABILITY.index("partial") + 1, "yellow").otherwise("green")
    return rows.withColumn("blockers", F.array_compact(F.array(*bad))).withColumn("profile", colour)


def worse(a: Column, b: Column) -> Column:
    """The worse of two authoring colours."""
    return F.when(rank_of(a, AUTHORING) >= rank_of(b, AUTHORING), a).otherwise(b)


def sidecar_role(columns: Column) -> Column:
    """The first role of which a table's columns (lower case) show an alias; else none."""
    role = F.lit("none")
    for name, aliases in reversed(SIDECAR_ROLES):
        role = F.when(F.arrays_overlap(columns, F.array(*[F.lit(a) for a in aliases])), name).otherwise(role)
    return role


def closure(residuals: Column, diagnostics: Column) -> Column:
    """Named residuals outrank diagnostics, which outrank ready."""
    return F.when(residuals > 0, "residual").when(diagnostics > 0, "diagnostic").otherwise("ready")
