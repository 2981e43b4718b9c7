"""Join shapes: range, anchored, scaled, positional, composite, neighbouring, nearest, ordered fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import with_rank


def first_containing(points: DataFrame, ranges: DataFrame, group: str, at: str, low: str, high: str, order: str, take: list[str], width: int) -> DataFrame:
    """points with the `take` columns of the first range (by order) of their group that holds `at`, null if none does.

    Ranges are dealt over buckets of `width`, so the join is an equality on (group,
    bucket) with the bounds as a residual and never a nested loop; only points that
    lie in several ranges are compared, on the ranges' order.
    """
    spread = ranges.select(F.col(group).alias("g_"), F.col(low).alias("low_"), F.col(high).alias("high_"), F.struct(F.col(order).alias("o"), *[F.col(c).alias(c) for c in take]).alias("r_"))
    spread = spread.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col("low_") / width).cast("long"), F.floor(F.col("high_") / width).cast("long"))))
    keyed = points.withColumn("bucket", F.floor(F.col(at) / width).cast("long"))
    hit = (F.col(group) == F.col("g_")) & (F.col("bucket") == F.col("bucket_")) & F.col(at).between(F.col("low_"), F.col("high_"))
    met = keyed.join(spread, hit, "left")
    best = met.groupBy(*points.columns).agg(F.min("r_").alias("r_"))
    return best.select(*points.columns, *[F.col(f"r_.{c}").alias(c) for c in take])


def anchored(anchors: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """First anchor of each key by order, left-joined to rows on the key, with found."""
    first = Window.partitionBy(key).orderBy(order)
    own = anchors.withColumn("n_", F.row_number().over(first)).filter("n_ = 1").drop("n_")
    marked = rows.withColumn("found_", F.lit(True))
    return own.join(marked, key, "left").withColumn("found", F.coalesce("found_", F.lit(False))).drop("found_")


def body_driven(rows: DataFrame, anchors: DataFrame, key: str, order: str) -> DataFrame:
    """Every row whose key has an anchor; of a key's anchors the last by order counts."""
    cols = [c for c in anchors.columns if c not in (key, order)]
    last = anchors.groupBy(key).agg(F.max(F.struct(order, *cols)).alias("a_")).select(key, *[F.col(f"a_.{c}").alias(c) for c in cols])
    return rows.join(last, key)


def scaled(pointers: DataFrame, rows: DataFrame, pointer: str, key: str, scale: int) -> DataFrame:
    """pointers = key * scale joined to rows; status invalid_pointer, missing or resolved."""
    keyed = pointers.withColumn("key_", F.when(F.col(pointer) % scale == 0, (F.col(pointer) / scale).cast("long")))
    met = keyed.join(rows.withColumn("hit_", F.lit(True)), F.col("key_") == F.col(key), "left")
    status = F.when(F.col("key_").isNull(), "invalid_pointer").when(F.col("hit_").isNull(), "missing").otherwise("resolved")
    return met.withColumn("status", status).drop("key_", "hit_")


def positional(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """n-th row of left with the n-th of right, each by its key; rows beyond the shorter side have no partner and go."""
    return with_rank(left, left_key, name="position").join(with_rank(right, right_key, name="position"), "position")


def neighbours(rows: DataFrame, order: str, within: list[str]) -> DataFrame:
    """rows with the previous and the next value of order among all rows of their group; joins come after."""
    w = Window.partitionBy(*within).orderBy(order)
    return rows.withColumn("prev_key", F.lag(order).over(w)).withColumn("next_key", F.lead(order).over(w))


def nearest(left: DataFrame, right: DataFrame, group: str, at: str, there: str, tolerance: int, key: str, order: str, take: list[str]) -> DataFrame:
    """left with the row of its group that lies nearest within tolerance; ties go to the first by order. Integer places.

    Both sides are dealt over buckets of tolerance + 1 places, each left row asking in
    its own and the two beside it, so a hot group spreads over its buckets.
    """
    width = tolerance + 1
    asks = left.withColumn("bucket_", F.explode(F.array(*[F.floor(F.col(at) / width) + d for d in (-1, 0, 1)])))
    gives = right.select(F.col(group).alias("g_"), F.col(there).alias("there_"), F.struct(F.col(order).alias("o"), *[F.col(c).alias(c) for c in take]).alias("r_"), F.floor(F.col(there) / width).alias("b_"))
    far = F.abs(F.col(at) - F.col("there_"))
    met = asks.join(gives, (F.col(group) == F.col("g_")) & (F.col("bucket_") == F.col("b_")) & (far <= tolerance))
    best = met.groupBy(key).agg(F.min(F.struct(far.alias("d"), F.col("r_.o").alias("o"), F.col("r_").alias("r"))).alias("m_"))
    picked = best.select(F.col(key), F.col("m_.d").alias("distance"), *[F.col(f"m_.r.{c}").alias(c) for c in take])
    return left.join(picked, key, "left")


def resolved(rows: DataFrame, targets: DataFrame, key: str, target_key: str) -> DataFrame:
    """rows with status resolved or missing_target by whether their key is a target's."""
    keys = targets.select(F.col(target_key).alias("t_")).distinct().withColumn("hit_", F.lit(True))
    met = rows.join(keys, F.col(key) == F.col("t_"), "left")
    return met.withColumn("status", F.when(F.col("hit_").isNull(), "missing_target").otherwise("resolved")).drop("t_", "hit_")


def key_forms(lookups: DataFrame, forms: list[Column], rows: DataFrame, row_forms: list[Column], key: str, row_key: str) -> DataFrame:
    """lookups with the row that the first matching form of their key finds; form k of a lookup meets form k of a row."""
    tried = lambda df, exprs, own: df.select(own, F.posexplode(F.array(*exprs)).alias("form", "form_value")).filter("form_value is not null")
    met = tried(lookups, forms, key).join(tried(rows, row_forms, row_key), ["form", "form_value"])
    best = met.groupBy(key).agg(F.min(F.struct("form", row_key)).alias("m_"))
    return lookups.join(best, key, "left").select(*lookups.columns, F.col("m_.form").alias("form"), F.col(f"m_.{row_key}").alias(row_key))


def merged_reports(reports: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer join of reports on their key; an absent side is null."""
    made = None
    for df in reports.values():
        made = df if made is None else made.join(df, key, "full_outer")
    return made


def over_keys(keys: list[DataFrame], key: str, looked_up: list[DataFrame]) -> DataFrame:
    """Distinct keys of all frames, left-joined to each lookup (one row a key)."""
    made = keys[0].select(key)
    for df in keys[1:]:
        made = made.unionByName(df.select(key))
    made = made.distinct()
    for df in looked_up:
        made = made.join(df, key, "left")
    return made


def overlay(base: DataFrame, over: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Full outer join in which over's values win where it has any."""
    top = over.select(key, *[F.col(v).alias(f"{v}_top") for v in values])
    return base.join(top, key, "full_outer").select(key, *[F.coalesce(f"{v}_top", v).alias(v) for v in values])


def cascade(rows: DataFrame, tests: list[tuple[str, Column]], otherwise: str, name: str) -> DataFrame:
    """rows with the name of the first test that holds."""
    found = F.lit(None)
    for label, test in reversed(tests):
        found = F.when(test, label).otherwise(found)
    return rows.withColumn(name, F.coalesce(found, F.lit(otherwise)))


def providers(rows: DataFrame, key: str, sources: list[tuple[str, DataFrame, str]], name: str) -> DataFrame:
    """rows with the value of the first provider that has one for the key, and the provider's name. Providers have a row a key."""
    for label, df, value in sources:
        rows = rows.join(df.select(key, F.col(value).alias(f"v_{label}")), key, "left")
    pick = F.lit(None)
    for label, _, _ in reversed(sources):
        pick = F.when(F.col(f"v_{label}").isNotNull(), label).otherwise(pick)
    rows = rows.withColumn(name, F.coalesce(*[F.col(f"v_{label}") for label, _, _ in sources])).withColumn("provider", F.coalesce(pick, F.lit("none")))
    return rows.drop(*[f"v_{label}" for label, _, _ in sources])


def outside(pointers: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """pointers whose keys are no row of starts."""
    return pointers.join(starts.select(*keys).distinct(), keys, "left_anti")


#: Patterns of one alternation.
ALTERNATIVES = 400


def pattern_counts(texts: DataFrame, text: str, words: list[str]) -> DataFrame:
    """(word, n): non-overlapping occurrences of a vocabulary's words, longer words first, an alternation for each ALTERNATIVES of them."""
    order = sorted(set(words), key=lambda w: (-len(w), w))
    patterns = ["(" + "|".join("\\Q" + w + "\\E" for w in order[at : at + ALTERNATIVES]) + ")" for at in range(0, len(order), ALTERNATIVES)]
    if not patterns:
        return texts.limit(0).select(F.lit("").alias("word"), F.lit(0).cast("long").alias("n"))
    found = F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(p), 1) for p in patterns]))
    return texts.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def table_pattern_counts(texts: DataFrame, text: str, patterns: DataFrame, word: str) -> DataFrame:
    """pattern_counts of the distinct words of a table of displays: a vocabulary, which the driver reads."""
    return pattern_counts(texts, text, [r[0] for r in patterns.filter(F.col(word) != "").select(word).distinct().collect()])
