"""Menu streams: lines with section codes, links and destinations, placed in a tree by depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.bytes import pointer, virtual_selector

from .joins import first_containing
from .streams import glyph_text
from .windows import paths

# Fixed values of the format.
LINK_STARTS, LINK_ENDS, POINTING_ENDS = ["42", "43", "4a"], ["62", "63", "6a"], ["62", "63"]


def lines(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_idx, byte_start, byte_end, section_codes, text, links): a row for each line of a menu stream that shows something.

    links: array<struct(label, block, offset, encoding, is_null)>; a link is what stands between
    a start and the next end, and its destination is the end's payload.
    """
    order = Window.partitionBy(*keys).orderBy("span")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = decoded.filter(~F.col("hidden") & (F.col("kind") != "padding"))
    rows = rows.withColumn("line_idx", F.coalesce(F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int") + 1)
    starts, ends = F.col("op").isin(LINK_STARTS), F.col("op").isin(LINK_ENDS)
    rows = rows.withColumn("link", F.sum(F.when(starts, 1).otherwise(0)).over(upto)).withColumn("state", F.last(F.when(starts, 1).when(ends, 0), ignorenulls=True).over(upto))
    shown = F.when(F.col("kind") == "glyph", glyph_text(F.col("code"), F.col("resolved"))).when(F.col("kind").isin("text", "ascii"), F.col("normalized"))
    rows = rows.withColumn("shown", shown)
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("span", F.col("shown").alias("s"))))), lambda p: p["s"]), "")
    seen = F.col("shown").isNotNull()
    target = F.max(F.when(F.col("op").isin(POINTING_ENDS), F.col("payload")))
    links = rows.filter(F.col("state").isNotNull() & ((F.col("state") == 1) | ends)).groupBy(*keys, "line_idx", "link").agg(joined(seen).alias("label"), target.alias("payload"), F.bool_or(ends).alias("ended")).filter("ended")
    to = pointer(F.unhex("payload"))
    place = F.when(F.length("payload") == 12, to)
    links = links.groupBy(*keys, "line_idx").agg(F.array_sort(F.collect_list(F.struct("link", "label", place["block"].alias("block"), place["offset"].alias("offset"), place["encoding"].alias("encoding"), ((place["block"] == 0) & (place["offset"] == 0)).alias("is_null")))).alias("links"))
    made = rows.groupBy(*keys, "line_idx").agg(
        F.min("start").alias("byte_start"), F.max("end").alias("byte_end"), F.trim(joined(seen)).alias("text"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "section", F.struct("span", "payload")))), lambda p: p["payload"]).alias("section_codes"))
    return made.join(links, [*keys, "line_idx"], "left").filter("text <> '' or links is not null")


def tree(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with depth, the rank of their first section code among their menu's (1 without one), and path of labels."""
    code = F.conv(F.get("section_codes", F.lit(0)), 16, 10).cast("long")
    coded = rows.withColumn("code_", code)
    ranks = coded.filter("code_ is not null").select(*keys, "code_").distinct().withColumn("depth", F.dense_rank().over(Window.partitionBy(*keys).orderBy("code_")))
    label = F.coalesce(F.nullif("text", F.lit("")), F.get("links", F.lit(0))["label"], F.lit(""))
    met = coded.join(ranks, [*keys, "code_"], "left").withColumn("depth", F.coalesce("depth", F.lit(1))).drop("code_").withColumn("label_", label)
    return paths(met, keys, "line_idx", "depth", "label_").drop("label_")


def destination_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, links, null_links, pointing): what the links of each menu add up to."""
    each = rows.select(*keys, F.explode("links").alias("l"))
    return each.groupBy(*keys).agg(F.count("*").alias("links"), F.count_if(F.col("l.is_null")).alias("null_links"), F.count_if(F.col("l.block").isNotNull() & ~F.col("l.is_null")).alias("pointing"))


def leaf_like(rows: DataFrame, keys: list[str], order: str, depth: str = "depth") -> DataFrame:
    """rows with leaf: the next row of their list is no deeper, or there is none."""
    after = F.lead(depth).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("leaf", F.coalesce(after <= F.col(depth), F.lit(True)))


def index_statistics(rows: DataFrame, components: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, family, key, n) of auxiliary index rows: depths, kinds of target, components that they lead to, null pointers and leaves.

    keys begin with package_id. A pointer is null, in the first component that holds its block, a selector, or leads to none.
    """
    ranges = components.filter("start_block > 0").select("package_id", F.col("component").alias("target"), "start_block", "end_block", "idx")
    known = first_containing(leaf_like(rows, keys, "line_no").select(*keys, "line_no", "depth", "block", "offset", "leaf"), ranges, "package_id", "block", "start_block", "end_block", "idx", ["target"], 64)
    null, chosen = (F.col("block") == 0) & (F.col("offset") == 0), virtual_selector(F.col("block"), F.col("offset"))
    kind = F.when(F.col("target").isNotNull(), "component").when(null, "null").when(chosen > 0, "selector").otherwise("none")
    entry = lambda family, key, keep: F.when(keep, F.struct(F.lit(family).alias("family"), key.cast("string").alias("key")))
    each = F.array_compact(F.array(
        entry("depth", F.col("depth"), F.lit(True)), entry("target", kind, F.lit(True)), entry("component", F.col("target"), F.col("target").isNotNull()),
        entry("pointer", F.lit("zero"), null), entry("row", F.lit("leaf"), F.col("leaf"))))
    return known.select(*keys, F.explode(each).alias("e")).groupBy(*keys, "e.family", "e.key").agg(F.count("*").alias("n"))
