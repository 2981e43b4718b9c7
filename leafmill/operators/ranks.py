"""Numbering of rows in a total order without putting them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.staging import scratch


def with_rank(df: DataFrame, key: str | list[str], ties: list[Column] | None = None, name: str = "rank") -> DataFrame:
    """df with the 1-based rank by (key, ties): ranks within ranges of the order, plus the rows of the ranges before."""
    return running(df, key, ties, {name: F.lit(1)})


def running(df: DataFrame, key: str | list[str], ties: list[Column] | None, sums: dict[str, Column]) -> DataFrame:
    """df with the running sum of each value in the order (key, ties), this row included.

    Rows are dealt to as many ranges as there are shuffle partitions, by the whole order,
    so that ties of a frequent key spread too. The ranges are written before they are
    counted: sampled bounds may differ when they are drawn again.
    """
    order = [F.col(k) for k in ([key] if isinstance(key, str) else key)] + list(ties or [])
    own = {name: f"own_{k}_" for k, name in enumerate(sums)}
    valued = df.select("*", *[sums[name].cast("long").alias(c) for name, c in own.items()])
    cut = scratch(valued.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    totals = cut.groupBy("range_").agg(*[F.sum(c).alias(c) for c in own.values()])
    bases = totals.select("range_", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base{c}") for c in own.values()])
    upto = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.select("*", *[F.sum(c).over(upto).alias(f"sum{c}") for c in own.values()]).join(F.broadcast(bases), "range_")
    return placed.select(*df.columns, *[(F.col(f"base{c}") + F.col(f"sum{c}")).cast("long").alias(name) for name, c in own.items()])
