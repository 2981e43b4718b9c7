"""Counter-style aggregation: merged counters, modes and medians with fixed ties, ranked states, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Ranks of states, best first.
CAPABILITY = ["yes", "n/a", "partial", "unknown", "no"]
AUTHORING = ["green", "gray", "yellow", "unknown", "red"]


def merged_counters(rows: DataFrame, counters: str) -> DataFrame:
    """(key, n): the sums of a map<string, long> column."""
    return rows.select(F.explode(counters).alias("key", "n")).groupBy("key").agg(F.sum("n").cast("long").alias("n"))


def rank_of(status: Column, order: list[str]) -> Column:
    """The place of a status in order; one that isn't there is the worst."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), status)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def worst(rows: DataFrame, by: str, status: str, order: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(F.max_by(status, F.struct(rank_of(F.col(status), order), status)).alias("worst_status"))


def mode(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value; of equals the smallest."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("mode_value"), F.max("n").alias("mode_count"))


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Element n div 2 of the sorted values: by counts of distinct values, so a hot group is summed before it meets."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(w))
    return ranked.filter("upto > total div 2").groupBy(by).agg(F.min(value).alias("upper_median"), F.max("total").alias("n_values"))


def entropy(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Shannon entropy in bits of the values of each group."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.join(totals, by).groupBy(by).agg((-F.sum(share * F.log2(share))).alias("entropy"), F.max("total").alias("total"))


def samples(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key by order, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= n)


def preferred(rows: DataFrame, by: str, preference: list[Column], take: list[str]) -> DataFrame:
    """The row of each key with the greatest preference."""
    best = rows.groupBy(by).agg(F.max_by(F.struct(*take), F.struct(*preference)).alias("b_"))
    return best.select(by, *[F.col(f"b_.{c}").alias(c) for c in take])


def top_sub_histogram(rows: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """(by, value, n, place): exact counts, the n largest of each key; ties by value."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), F.asc_nulls_first(value)))
    return counts.withColumn("place", place).filter(F.col("place") <= n)
