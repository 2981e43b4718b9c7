"""Checks of index trees and pointers: branch rows, reachable leaves, runs of equal keys, pointers off their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.bytes import BLOCK, be
from leafmill.staging import scratch

from .streams import LEAF_FLAG

SENTINEL = "^(FF)+$"
LAST_SIBLING = 0x2000


def branch_rows(pages: DataFrame) -> DataFrame:
    """(package_id, component, logical_block, row_idx, key_hex, child_block, last_sibling) of branch pages: fixed slots of key and child."""
    word, count = be(F.col("page"), 0, 2), be(F.col("page"), 2, 2)
    own = pages.withColumn("word", word).withColumn("slot", (F.col("word").bitwiseAND(0xFF) + 4).cast("int")).filter((F.col("word").bitwiseAND(LEAF_FLAG) == 0) & (count > 0) & (F.col("slot") >= 6))
    rows = own.withColumn("row_idx", F.explode(F.sequence(F.lit(1), count.cast("int"))))
    at = 4 + (F.col("row_idx") - 1) * F.col("slot")
    rows = rows.filter(at + F.col("slot") <= BLOCK)
    key = F.regexp_extract(F.hex(F.substr("page", at + 1, F.col("slot") - 4)), "^((?:(?!00)..)*)", 1)
    return rows.select("package_id", "component", "logical_block", "row_idx", key.alias("key_hex"), be(F.col("page"), at + F.col("slot") - 4, 4).alias("child_block"), (F.col("word").bitwiseAND(LAST_SIBLING) != 0).alias("last_sibling"))


def branch_issues(branches: DataFrame, pages: DataFrame) -> DataFrame:
    """(package_id, component, block, code): children outside the component, keys out of order, last siblings without a sentinel."""
    keys = ["package_id", "component"]
    there = pages.select(*keys, F.col("logical_block").alias("child_block"))
    lost = branches.join(there, [*keys, "child_block"], "left_anti").select(*keys, F.col("logical_block").alias("block"), F.lit("invalid_child_block").alias("code"))
    w = Window.partitionBy(*keys, "logical_block").orderBy("row_idx")
    after = branches.withColumn("before", F.lag("key_hex").over(w)).filter("before > key_hex").select(*keys, F.col("logical_block").alias("block"), F.lit("keys_out_of_order").alias("code"))
    final = branches.filter("last_sibling").groupBy(*keys, "logical_block").agg(F.max_by("key_hex", "row_idx").alias("k"))
    bare = final.filter(~F.col("k").rlike(SENTINEL)).select(*keys, F.col("logical_block").alias("block"), F.lit("missing_sentinel").alias("code"))
    return lost.unionByName(after).unionByName(bare)


def unreachable(branches: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that no path from the component's first page reaches, level by level until nothing new is found; loops end too."""
    keys = ["package_id", "component"]
    children = branches.select(*keys, "logical_block", "child_block")
    edge = scratch(pages.groupBy(*keys).agg(F.min("logical_block").alias("logical_block")), "reached")
    reached = edge
    while not edge.isEmpty():
        below = edge.join(children, [*keys, "logical_block"]).select(*keys, F.col("child_block").alias("logical_block")).distinct()
        edge = scratch(below.join(reached, [*keys, "logical_block"], "left_anti"), "reached")
        reached = reached.unionByName(edge)
    return pages.select(*keys, "logical_block").join(reached, [*keys, "logical_block"], "left_anti")


def scattered_keys(rows: DataFrame) -> DataFrame:
    """(package_id, component, key, runs): keys whose rows don't stand together."""
    w = Window.partitionBy("package_id", "component").orderBy("page_idx", "row_idx")
    new = F.when(F.lag("target_key").over(w).eqNullSafe(F.col("target_key")), 0).otherwise(1)
    return rows.withColumn("new", new).groupBy("package_id", "component", F.col("target_key").alias("key")).agg(F.sum("new").alias("runs")).filter("runs > 1")


def pointer_issues(points: DataFrame, starts: DataFrame, code: str) -> DataFrame:
    """(package_id, place, code) of pointers (package_id, place) that are no start."""
    return points.join(starts.select("package_id", "place").distinct(), ["package_id", "place"], "left_anti").select("package_id", "place", F.lit(code).alias("code"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("package_id", "code").agg(F.count("*").alias("n"))
