"""Classification on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import classify
from leafmill.plans.registry import query


@query("""
WITH s AS (SELECT source, count(*) AS markers, CAST(sum(n_chars) AS BIGINT) AS size, CAST(sum(CASE WHEN lang = 'es' THEN 1 ELSE 0 END) AS BIGINT) AS targets FROM documents GROUP BY source)
SELECT source, CASE WHEN size = 0 THEN 'empty' WHEN markers * 3000 > size THEN 'dense' WHEN targets > 0 THEN 'indexed' ELSE 'sliced' END AS shape
FROM (SELECT source, markers * 64 AS m64, markers, size, targets FROM s)
""".replace("markers * 3000 > size", "m64 * 40 > size"))
def body_shape_class(t):
    """Sources by the density of their documents."""
    s = t("documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"), F.count_if(F.col("lang") == "es").alias("targets"))
    return s.select("source", classify.body_shape(F.col("size"), F.col("n") * 40, F.col("targets")).alias("shape"))


@query("""
WITH g AS (
  SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_size END AS n, CASE WHEN p_size % 3 = 0 THEN p_name END AS display, p_size % 5 = 1 AS image, p_size % 7 = 2 AS bitmap,
    p_size % 7 = 2 AND p_size % 2 = 0 AS blank, CASE WHEN p_partkey % 4 = 0 THEN 'b1' ELSE 'a1' END AS code, p_size % 11 = 5 AS entry FROM part),
b AS (SELECT *, CASE WHEN n > 0 THEN CASE WHEN display IS NOT NULL THEN 'unicode_mapped' WHEN image THEN 'image_backed' WHEN blank OR (NOT bitmap AND code = 'b1') THEN 'formatting_helper'
    WHEN bitmap THEN 'bitmap_backed' WHEN entry THEN 'renderer_entry_backed' ELSE 'display_unresolved' END
  ELSE CASE WHEN display IS NOT NULL THEN 'unused_mapping' WHEN image OR bitmap THEN 'unused_resource' ELSE 'unused' END END AS bucket FROM g)
SELECT bucket, count(*) AS codes, CAST(sum(n) AS BIGINT) AS occurrences FROM b GROUP BY bucket
""")
def glyph_readiness(t):
    """Parts as glyph codes with derived evidence, by bucket."""
    s, k = F.col("p_size"), F.col("p_partkey")
    rows = t("part").select(F.when(k % 10 == 0, 0).otherwise(s).alias("n"), F.when(s % 3 == 0, F.col("p_name")).alias("display"), (s % 5 == 1).alias("image"), (s % 7 == 2).alias("bitmap"),
                            ((s % 7 == 2) & (s % 2 == 0)).alias("blank"), F.when(k % 4 == 0, "b1").otherwise("a1").alias("code"), (s % 11 == 5).alias("entry"))
    bucket = classify.glyph_bucket(F.col("n"), F.col("display"), F.col("image"), F.col("blank"), F.col("bitmap"), F.col("entry"), F.col("code"))
    return rows.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("codes"), F.sum("n").alias("occurrences"))


@query("""
WITH s AS (
  SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS solvent, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_acctbal > 9990) AS rich FROM customer GROUP BY 1),
c AS (SELECT c_nationkey, CASE WHEN solvent = n THEN 'yes' WHEN solvent = 0 THEN 'no' ELSE 'partial' END AS body, CASE WHEN building = n THEN 'yes' WHEN building = 0 THEN 'no' ELSE 'partial' END AS indexes,
  CASE WHEN rich > 0 THEN 'yes' ELSE 'n/a' END AS media FROM s)
SELECT c_nationkey, body, indexes, media, concat_ws(';', CASE WHEN body NOT IN ('yes', 'n/a') THEN 'body:' || body END, CASE WHEN indexes NOT IN ('yes', 'n/a') THEN 'indexes:' || indexes END) AS blockers,
  CASE WHEN 'no' IN (body, indexes) THEN 'red' WHEN 'partial' IN (body, indexes) THEN 'yellow' ELSE 'green' END AS profile FROM c
""")
def readiness_matrix(t):
    """Per-nation capabilities, blockers and colour."""
    s = t("customer").groupBy("c_nationkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("solvent"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.count_if(F.col("c_acctbal") > 9990).alias("rich"))
    rows = s.select("c_nationkey", classify.coverage_status(F.col("solvent"), F.col("n")).alias("body"), classify.coverage_status(F.col("building"), F.col("n")).alias("indexes"), F.when(F.col("rich") > 0, "yes").otherwise("n/a").alias("media"))
    return classify.readiness(rows, ["body", "indexes", "media"]).withColumn("blockers", F.array_join("blockers", ";"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("""
WITH c AS (
  SELECT 'documents' AS tbl, column_name FROM (DESCRIBE documents) UNION ALL SELECT 'pages', column_name FROM (DESCRIBE pages) UNION ALL SELECT 'labels', column_name FROM (DESCRIBE labels)
  UNION ALL SELECT 'benchmark', column_name FROM (DESCRIBE benchmark) UNION ALL SELECT 'conversations', column_name FROM (DESCRIBE conversations) UNION ALL SELECT 'events', column_name FROM (DESCRIBE events)
  UNION ALL SELECT 'part', column_name FROM (DESCRIBE part) UNION ALL SELECT 'orders', column_name FROM (DESCRIBE orders) UNION ALL SELECT 'region', column_name FROM (DESCRIBE region)
  UNION ALL SELECT 'nation', column_name FROM (DESCRIBE nation) UNION ALL SELECT 'customer', column_name FROM (DESCRIBE customer) UNION ALL SELECT 'supplier', column_name FROM (DESCRIBE supplier)
  UNION ALL SELECT 'lineitem', column_name FROM (DESCRIBE lineitem) UNION ALL SELECT 'embeddings', column_name FROM (DESCRIBE embeddings)),
l AS (SELECT tbl, list(lower(column_name)) AS cols, count(*) AS n_columns FROM c GROUP BY tbl)
SELECT tbl, n_columns, CASE WHEN list_has_any(cols, ['html', 'f_html', 'contents_html_box', 'body', 'text']) THEN 'body' WHEN list_has_any(cols, ['blob', 'data', 'image', 'sound']) THEN 'media'
  WHEN list_has_any(cols, ['example', 'sentence']) THEN 'example' WHEN list_has_any(cols, ['keyword', 'f_keyword', 'key']) THEN 'search' ELSE 'none' END AS role FROM l
""")
def sidecar_role(t):
    """Roles of the driver tables by their column names."""
    frames = {name: t(name) for name in TABLES}
    spark = next(iter(frames.values())).sparkSession
    rows = spark.createDataFrame([(name, [c.lower() for c in df.columns]) for name, df in frames.items()], "tbl string, cols array<string>")
    return rows.select("tbl", F.size("cols").cast("long").alias("n_columns"), classify.sidecar_role(F.col("cols")).alias("role"))
