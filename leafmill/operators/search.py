"""Key lookup over a table of keyed rows: exact, forward, backward and all three merged; one term or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PHASES = ["exact", "forward", "backward"]


def _matches(phase: str, key: Column, query: Column) -> Column:
    return {"exact": key == query, "forward": F.startswith(key, query), "backward": F.endswith(key, query)}[phase]


def search(rows: DataFrame, key: str, query: str, phases: list[str], identity: list[str], limit: int | None, normalized: Column | None = None, query_key: str | None = None) -> DataFrame:
    """Hits of one term: phase by phase, each row (by identity) once, at its first phase; hit_id runs from 1.

    A row's phase is decided in the scan and the limit keeps at most `limit` rows of
    each task, so nothing but the hits is sorted. Without a limit all hits come, neither
    sorted nor numbered (no hit_id), so no task holds them all. A term whose normalized form is
    empty, but which isn't blank itself, matches every row forward.
    """
    norm = normalized if normalized is not None else F.col(key)
    wanted = F.lit(query if query_key is None else query_key)
    if not query.strip():
        rows = rows.filter(F.lit(False))
    phase = F.lit(None).cast("int")
    for p in reversed(phases):
        phase = F.when(_matches(p, norm, wanted), PHASES.index(p)).otherwise(phase)
    hits = rows.withColumn("phase_", phase).withColumn("norm_", norm).filter("phase_ is not null")
    first = hits.groupBy(*identity).agg(F.min(F.struct("phase_", "norm_", F.col(key).alias("matched"))).alias("m_"))
    named = F.element_at(F.array(*[F.lit(p) for p in PHASES]), F.col("m_.phase_") + 1)
    fields = [named.alias("profile"), F.col("m_.matched").alias("matched_key"), *identity]
    if limit is None:
        return first.select(*fields)
    order = [F.col("m_.phase_"), F.col("m_.norm_"), *map(F.col, identity)]
    top = first.orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("hit_id"), *fields)  # over `limit` rows


def search_many(rows: DataFrame, key: str, terms: DataFrame, term: str, identity: list[str], limit: int, least: int) -> DataFrame:
    """Forward hits of many terms, at most `limit` for each: an equality on the first `least` characters, then the prefix.

    Shorter terms meet by as many characters as they have, one equality for each length;
    the empty term, which begins every key, takes the first rows of all.
    """
    asks = terms.select(F.col(term).alias("term")).filter("term is not null").distinct()
    made = rows.orderBy(key, *identity).limit(limit).join(F.broadcast(asks.filter("term = ''")), how="cross")  # at most one such term
    for n in range(1, least + 1):
        own = asks.filter(F.length("term") == n if n < least else F.length("term") >= n).withColumn("head", F.substring("term", 1, n))
        met = rows.withColumn("head", F.substring(key, 1, n)).join(own, "head").drop("head")
        made = made.unionByName(met.filter(F.startswith(F.col(key), F.col("term"))) if n == least else met)
    place = F.row_number().over(Window.partitionBy("term").orderBy(key, *identity))
    return made.withColumn("hit_id", place).filter(F.col("hit_id") <= limit).select("term", "hit_id", F.col(key).alias("matched_key"), *identity)
