"""Sequence operators: slices, bigrams, forward fill, clipped depth, paths, islands and gaps, frames by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def _by(within: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*([within] if isinstance(within, str) else within))


def slices(marks: DataFrame, within: str | list[str], start: str, ends: DataFrame, end: str) -> DataFrame:
    """Distinct sorted starts of each stream as [start, next); the last ends at the stream's end."""
    w = _by(within).orderBy(start)
    own = marks.select(within, start).distinct().join(ends.select(within, F.col(end).alias("end_")), within)
    return own.withColumn("slice_end", F.coalesce(F.lead(start).over(w), F.col("end_"))).withColumn("slice", F.row_number().over(w)).drop("end_")


def with_previous(rows: DataFrame, within: str | list[str], order: list[str], value: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.lag(value).over(_by(within).orderBy(*order)))


def filled(rows: DataFrame, within: str | list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the last value so far that isn't null."""
    w = _by(within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def clipped_depth(rows: DataFrame, within: str | list[str], order: list[str], step: Column, name: str = "depth") -> DataFrame:
    """rows with a running sum of step that never falls below zero: the sum less its least value so far, if negative."""
    w = _by(within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("sum_", F.sum(step).over(w))
    return summed.withColumn(name, F.col("sum_") - F.least(F.lit(0), F.min("sum_").over(w))).drop("sum_")


def paths(rows: DataFrame, within: str | list[str], order: str, depth: str, label: str, known: int | None = None) -> DataFrame:
    """rows with path, the labels of their ancestors and themselves; depths run from 1 to whatever the rows have.

    The ancestor at depth d is the last row at depth d or less; it counts only if it is at d.
    One aggregate finds the largest depth, as many columns of one window the ancestors. Where
    the caller knows that no row is deeper than `known`, the aggregate is left out; a deeper row fails.
    """
    deepest = known or rows.agg(F.max(depth)).first()[0] or 1
    w = _by(within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = [F.last(F.when(F.col(depth) <= d, F.struct(F.col(depth).alias("d"), F.col(label).alias("l"))), ignorenulls=True).over(w) for d in range(1, deepest + 1)]
    named = rows.withColumn("up_", F.array(*at))
    kept = F.filter("up_", lambda x, k: x.isNotNull() & (x["d"] == k + 1) & (k < F.col(depth)))
    path = F.transform(kept, lambda x: x["l"])
    if known:
        path = F.when(F.col(depth) > known, F.raise_error(F.lit(f"a row is deeper than {known}")).cast("array<string>")).otherwise(path)
    return named.withColumn("path", path).drop("up_")


def places_above(rows: DataFrame, within: str | list[str], order: str, depth: str, levels: int) -> DataFrame:
    """rows with above_1 to above_<levels>: the place of the last row at that depth or less, rows of the same place among them, nulls last."""
    w = _by(within).orderBy(F.col(order).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({f"above_{d}": F.max(F.when(F.col(depth) <= d, F.col(order))).over(w) for d in range(1, levels + 1)})


def _runs(rows: DataFrame, within: str | list[str], start: str, end: str) -> tuple[DataFrame, WindowSpec]:
    """(within, start, end) with fresh_, whether an island begins, and to_, the greatest end of the row's island so far;
    and the order in which the rows stand. Windows of that order all share one sort, the only thing a task holds.
    """
    order = _by(within).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    upto, before = (order.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    fresh = (F.row_number().over(order) == 1) | F.coalesce(F.col(start) > F.max(end).over(before) + 1, F.lit(False))
    own = rows.select(*([within] if isinstance(within, str) else within), start, end).withColumn("fresh_", fresh)
    numbered = own.withColumn("island_", F.sum(F.col("fresh_").cast("long")).over(upto))
    # Numbers rise, so the greatest (number, end) so far is of the row's own island.
    return numbered.withColumn("to_", F.max(F.struct("island_", end)).over(upto)[end]).drop("island_"), order


def islands(rows: DataFrame, within: str | list[str], start: str, end: str) -> DataFrame:
    """Inclusive intervals merged where they overlap or adjoin: (within, island_start, island_end)."""
    runs, order = _runs(rows, within, start, end)
    begun = F.last(F.when(F.col("fresh_"), F.col(start)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    closed = F.lead("fresh_", 1, True).over(order)
    ended = runs.withColumn("island_start", begun).withColumn("closed_", closed).filter("closed_")
    return ended.select(*([within] if isinstance(within, str) else within), "island_start", F.col("to_").alias("island_end"))


def gaps(rows: DataFrame, within: str | list[str], first: Column, last: Column, start: str = "island_start", end: str = "island_end") -> DataFrame:
    """What inclusive intervals, merged or not, leave of [first, last], inclusive: (within, gap_start, gap_end).

    A gap lies before each island and one behind the last: both come from the pass that finds the islands.
    """
    runs, order = _runs(rows, within, start, end)
    ahead = F.when(F.col("fresh_"), F.struct((F.coalesce(F.lag("to_").over(order) + 1, first)).alias("gap_start"), (F.col(start) - 1).alias("gap_end")))
    most = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, 0))
    tail = F.when(F.lead(F.lit(False), 1, True).over(order), F.struct((most + 1).alias("gap_start"), last.alias("gap_end")))
    found = runs.withColumn("ahead_", ahead).withColumn("tail_", tail).filter("ahead_ is not null or tail_ is not null")
    return found.select(*([within] if isinstance(within, str) else within), F.inline(F.array("ahead_", "tail_"))).filter("gap_start <= gap_end")


def preceding_within(rows: DataFrame, within: str | list[str], at: str, reach: int, value: Column, name: str) -> DataFrame:
    """rows with the last value that isn't null among the rows at most reach before them, by value of `at`, themselves excluded."""
    w = _by(within).orderBy(at).rangeBetween(-reach, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))
