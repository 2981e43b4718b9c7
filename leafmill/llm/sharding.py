"""Extendible hashing: a directory of hash-prefix bits whose buckets split only while over a byte limit.

Bytes are summed once over fine cells of hash prefixes; a bucket of the directory
is the shallowest prefix whose bytes fit the limit (each shallower one was over it
and split).  Cells still over the limit are summed again with more bits, and rows
that agree in all HASH_BITS bits, which no further bit can part, go to a chain of
overflow shards by running sums within each input partition.  Only DataFrame
functions are used; what is summed is bounded by the directory, not by the rows.

Results in odd cases: a null key hashes as ''; a null size is 0 bytes; repeated
keys may share a shard or a chain; a row over the limit gets a shard of its own
(shard_bytes then exceeds the limit); an empty table gives an empty table; other
columns are carried as they are unless they have a result's name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.staging import scratch

HASH_BITS = 60
#: Bits that a round looks beyond those that would do for even buckets.
SLACK_BITS = 7
ROUND_BITS = 8
SHARD_BYTES = 1 << 20


def hash_bits(key: Column) -> Column:
    """The first HASH_BITS bits of the key's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: str, bits: int) -> Column:
    return F.shiftright(F.col(h), HASH_BITS - bits)


def _split(cells: DataFrame, least: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth) for cells of `bits` bits: the depth of the bucket that holds each, of least or more; null if the cell itself is over the limit.

    A bucket is a prefix that fits while its parent doesn't; each parent has two children,
    and each bucket spreads over its own cells, so no prefix gathers rows.
    """
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("depth"))
    sums = levels.groupBy("depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix")).agg(F.sum("bytes").alias("all_bytes"))
    parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), (F.col("all_bytes") > limit).alias("parent_over"))
    met = sums.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left")
    fits = met.filter((F.col("all_bytes") <= limit) & F.coalesce("parent_over", F.lit(True)))
    first, last = F.expr(f"shiftleft(prefix, {bits} - depth)"), F.expr(f"shiftleft(prefix + 1, {bits} - depth) - 1")
    inside = fits.select(F.explode(F.sequence(first, last)).alias("cell"), "depth")
    over = sums.filter((F.col("depth") == bits) & (F.col("all_bytes") > limit)).select(F.col("prefix").alias("cell"), F.lit(None).cast("int").alias("depth"))
    return inside.unionByName(over)


def assign(df: DataFrame, key: str, size: Column, carry: list[str], limit: int = SHARD_BYTES) -> DataFrame:
    """carry columns with n_bytes, depth, shard, shard_bytes and shard_rows of each row's shard.

    A shard's name is 'b' and its prefix bits, and '.n' for the n-th of an overflow chain.
    """
    wanted = [c for c in carry if c not in ("n_bytes", "depth", "shard", "shard_bytes", "shard_rows")]
    # Carried columns have names of their own until the end, so that none is in the way.
    h, part, carry = "h", "part", [f"c_{k}" for k in range(len(wanted))]
    rows = scratch(df.select(*[F.col(c).alias(own) for c, own in zip(wanted, carry, strict=True)], hash_bits(F.col(key)).alias(h), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"), F.spark_partition_id().alias(part)), "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    least, bits = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK_BITS)
    named, left = None, rows
    while True:
        cells = left.groupBy(_prefix(h, bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        found = _split(cells, least, bits, limit)
        met = left.withColumn("cell", _prefix(h, bits)).join(found, "cell")
        if bits == HASH_BITS:
            break
        inside = met.filter(F.col("depth").isNotNull())
        over = scratch(met.filter(F.col("depth").isNull()).select(*carry, h, "n_bytes", part), "over")
        named = inside if named is None else named.unionByName(inside)
        if over.isEmpty():
            met = None
            break
        left, least, bits = over, bits + 1, min(HASH_BITS, bits + ROUND_BITS)
    out = [*carry, "n_bytes", "depth", "shard"]
    bits_of = F.expr(f"if(depth = 0, '', lpad(bin(shiftright({h}, {HASH_BITS} - depth)), depth, '0'))")
    result = named.withColumn("shard", F.concat(F.lit("b"), bits_of)).select(*out) if named is not None else None
    if met is not None:
        fitting = met.filter(F.col("depth").isNotNull()).withColumn("shard", F.concat(F.lit("b"), bits_of)).select(*out)
        chained = _chain(met.filter(F.col("depth").isNull()).drop("cell", "depth"), h, part, limit).withColumn("depth", F.lit(HASH_BITS))
        chained = chained.withColumn("shard", F.concat(F.lit("b"), F.lpad(F.bin(F.col(h)), HASH_BITS, "0"), F.lit("."), F.col("link").cast("string"))).select(*out)
        more = fitting.unionByName(chained)
        result = more if result is None else result.unionByName(more)
    sums = result.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    named_again = [F.col(own).alias(c) for c, own in zip(wanted, carry, strict=True)]
    return result.join(sums, "shard").select(*named_again, "n_bytes", "depth", "shard", "shard_bytes", "shard_rows")


def _chain(rows: DataFrame, h: str, part: str, limit: int) -> DataFrame:
    """rows of equal hash with `link`, their place in the chain: half a limit of running bytes each; rows over half a limit stand alone (odd links)."""
    half = max(1, limit // 2)
    rows = rows.withColumn("alone", F.col("n_bytes") > half)
    weight = F.when(F.col("alone"), F.lit(1)).otherwise(F.col("n_bytes"))
    sums = rows.groupBy(h, "alone", part).agg(F.sum(weight).alias("here"))
    before = Window.partitionBy(h, "alone").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("here").over(before), F.lit(0))).drop("here")
    running = Window.partitionBy(h, "alone", part).orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum(weight).over(running), F.lit(0))
    met = rows.join(starts, [h, "alone", part]).withColumn("at", at)
    return met.withColumn("link", F.when(F.col("alone"), 2 * F.col("at") + 1).otherwise(2 * F.floor(F.col("at") / half))).drop("at", "base", "alone")


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder for each shard, each written by one task; a shard fits the byte limit."""
    assigned.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


ORACLE = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, CAST(COALESCE(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, {HASH_BITS // 4}) AS BIGINT) AS h
  FROM documents),
split AS (
  SELECT doc_id, n_bytes, h, 0 AS depth, SUM(n_bytes) OVER () AS total FROM rows_
  UNION ALL
  SELECT doc_id, n_bytes, h, depth + 1, SUM(n_bytes) OVER (PARTITION BY h >> ({HASH_BITS} - depth - 1))
  FROM split WHERE total > {SHARD_BYTES} AND depth < {HASH_BITS}),
leaf AS (
  SELECT doc_id, n_bytes, h, depth, total AS shard_bytes FROM split WHERE total <= {SHARD_BYTES}),
named AS (
  SELECT doc_id, n_bytes, depth, shard_bytes,
         'b' || CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h >> ({HASH_BITS} - depth)), 64, '0'), depth) END AS shard
  FROM leaf)
SELECT doc_id, n_bytes, depth, shard, CAST(shard_bytes AS BIGINT) AS shard_bytes,
       COUNT(*) OVER (PARTITION BY shard) AS shard_rows
FROM named
"""
