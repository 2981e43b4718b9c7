"""Predicates, evidence, set operations and reports on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import bytes as binary
from leafmill.operators import joins
from leafmill.plans.registry import query
from leafmill.sinks import reports


@query("""
WITH f AS (SELECT source, regexp_extract(text, '^\\S+') AS w FROM documents),
s AS (SELECT source, count(*) AS n, avg(CASE WHEN regexp_matches(w, '^[A-Z][a-z]+$') THEN 1.0 ELSE 0.0 END) AS ratio FROM f GROUP BY source)
SELECT source, n, round(ratio, 8) AS ratio, CASE WHEN n < 4 THEN 'few' WHEN ratio >= 0.6 THEN 'evident' ELSE 'weak' END AS evidence FROM s
""")
def ratio_evidence(t):
    """Share of samples with a property; 0.6 or more of 4 or more is evidence."""
    word = F.regexp_extract("text", r"^\S+", 0)
    s = t("documents").groupBy("source").agg(F.count("*").alias("n"), F.avg(word.rlike("^[A-Z][a-z]+$").cast("double")).alias("r"))
    return s.select("source", "n", F.round("r", 8).alias("ratio"), F.when(F.col("n") < 4, "few").when(F.col("r") >= 0.6, "evident").otherwise("weak").alias("evidence"))


@query("""
WITH n AS (SELECT user_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
c AS (SELECT user_id, stride, rn % stride AS phase, rn // stride AS k, event_type FROM n, (SELECT unnest(range(1, 9)) AS stride)),
s AS (SELECT user_id, stride, phase, count(*) AS n, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS ratio FROM c WHERE k < 64 GROUP BY ALL)
SELECT user_id, CAST(stride AS INTEGER) AS stride, CAST(phase AS INTEGER) AS phase, n, round(ratio, 8) AS ratio FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ratio DESC, n DESC, stride, phase) AS best FROM s) WHERE best = 1
""")
def stride_phase(t):
    """The stride and phase whose first 64 rows have the largest share of a property."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = t("events").select("user_id", "event_type", rn.alias("rn")).withColumn("stride", F.explode(F.sequence(F.lit(1), F.lit(8))))
    rows = rows.filter(F.floor(F.col("rn") / F.col("stride")) < 64).groupBy("user_id", "stride", (F.col("rn") % F.col("stride")).alias("phase"))
    s = rows.agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "click").cast("double")).alias("r"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("r"), F.desc("n"), "stride", "phase"))
    return s.withColumn("best", place).filter("best = 1").select("user_id", "stride", "phase", "n", F.round("r", 8).alias("ratio"))


@query("SELECT regexp_extract(p_name, '^(\\w+)', 1) AS family, count(*) AS n, count(DISTINCT p_name) AS names FROM part GROUP BY 1")
def name_families(t):
    return t("part").groupBy(F.regexp_extract("p_name", r"^(\w+)", 1).alias("family")).agg(F.count("*").alias("n"), F.count_distinct("p_name").alias("names"))


@query("""
WITH c AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_type, p_size, n FROM c ORDER BY n DESC, p_brand, p_type, p_size LIMIT 20
""")
def composite_frequency(t):
    """The commonest combinations of three columns."""
    return t("part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand", "p_type", "p_size").limit(20)


@query("""
SELECT s_suppkey, least(count(l_suppkey), 32) AS refs FROM supplier LEFT JOIN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) l ON s_suppkey = l_suppkey GROUP BY s_suppkey
""")
def reference_counts(t):
    """Rows that refer to an address, counted up to 32."""
    refs = t("lineitem").filter("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return t("supplier").select("s_suppkey").join(refs, "s_suppkey", "left").select("s_suppkey", F.least(F.coalesce("n", F.lit(0)), F.lit(32)).cast("long").alias("refs"))


@query("""
WITH a AS (SELECT conv_id, turn, role FROM conversations), s AS (
  SELECT COALESCE(x.turn, y.turn) AS turn, COALESCE(x.conv_id, y.conv_id) AS conv_id, x.role IS NOT NULL AND y.role IS NOT NULL AS both_sides
  FROM (SELECT * FROM a WHERE conv_id % 2 = 0) x FULL OUTER JOIN (SELECT conv_id - 1 AS conv_id, turn, role FROM a WHERE conv_id % 2 = 1) y ON x.conv_id = y.conv_id AND x.turn = y.turn)
SELECT conv_id, count(*) AS lines, bool_and(both_sides) AS synchronized FROM s GROUP BY conv_id
""")
def parallel_zip(t):
    """Two numbered lists side by side, and whether they are as long."""
    turns = t("conversations").select("conv_id", "turn", "role")
    x = turns.filter("conv_id % 2 = 0").select("conv_id", "turn", F.col("role").alias("a"))
    y = turns.filter("conv_id % 2 = 1").select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("role").alias("b"))
    both = x.join(y, ["conv_id", "turn"], "full_outer")
    return both.groupBy("conv_id").agg(F.count("*").alias("lines"), F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("synchronized"))


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'both' AS side, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL
SELECT 'only_f', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'only_p', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)
""")
def key_sets(t):
    """Keys in both sets and in either alone."""
    a, b = (t("orders").filter(F.col("o_orderstatus") == s).select("o_custkey") for s in "FP")
    counted = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return counted(a.intersect(b), "both").unionByName(counted(a.subtract(b), "only_f")).unionByName(counted(b.subtract(a), "only_p"))


@query("""
SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"region":{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}}' AS value
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def canonical_rows(t):
    """Rows as JSON with sorted keys, nested ones too."""
    met = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return reports.canonical_json(met.select("n_nationkey", "n_name", F.struct("r_regionkey", "r_name").alias("region")))


@query("""
SELECT source, count(*) FILTER (WHERE text ILIKE '%the %') AS with_the, count(*) FILTER (WHERE text LIKE '%***%') AS starred,
  count(*) FILTER (WHERE trim(regexp_replace(text, '\\s', '', 'g')) = '' OR regexp_matches(trim(text), '^[0-9A-Fa-f]{8,16}$')) AS useless FROM documents GROUP BY source
""")
def predicate_counts(t):
    """LIKE predicates and bodies of nothing but hexadecimal digits, counted."""
    x = F.col("text")
    useless = (F.regexp_replace(x, r"\s", "") == "") | F.trim(x).rlike("^[0-9A-Fa-f]{8,16}$")
    return t("documents").groupBy("source").agg(F.count_if(x.ilike("%the %")).alias("with_the"), F.count_if(x.like("%***%")).alias("starred"), F.count_if(useless).alias("useless"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 16) << 28 AS block, CASE WHEN l_linenumber % 2 = 0 THEN 65535 ELSE l_linenumber END AS off FROM lineitem)
SELECT CASE WHEN off = 65535 AND (block & 268435455) = 0 THEN block >> 28 END AS selector, count(*) AS n FROM p GROUP BY 1
""")
def virtual_selectors(t):
    """Pointers that name a selector instead of a place."""
    block = F.shiftleft(F.col("l_orderkey") % 16, 28)
    off = F.when(F.col("l_linenumber") % 2 == 0, 65535).otherwise(F.col("l_linenumber"))
    return t("lineitem").groupBy(binary.virtual_selector(block, off).alias("selector")).agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, reverse(c_name) AS stored, CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY reverse(c_name)) AS INTEGER) AS place FROM customer
""")
def suffix_order(t):
    """Keys in the order of their reversed spelling."""
    return t("customer").select("c_custkey", F.reverse("c_name").alias("stored"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.reverse("c_name"))).alias("place"))


@query("""
WITH r AS (SELECT doc_id, source, 'lang:' || lang AS tag FROM documents UNION ALL SELECT l.doc_id, source, 'quality:' || quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id
  UNION ALL SELECT l.doc_id, source, 'toxic' FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 1)
SELECT source, tag, count(*) AS n FROM r GROUP BY source, tag
""")
def edge_union(t):
    """Edges of several producers in one table, counted by kind."""
    docs = t("documents").select("doc_id", "source", "lang")
    labelled = t("labels").join(docs, "doc_id")
    parts = [docs.select("source", F.concat(F.lit("lang:"), "lang").alias("tag")), labelled.select("source", F.concat(F.lit("quality:"), F.col("quality").cast("string")).alias("tag")), labelled.filter("toxic = 1").select("source", F.lit("toxic").alias("tag"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source", "tag").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT user_id, event_id, ts, event_type, value, ROW_NUMBER() OVER (PARTITION BY user_id, event_type, value ORDER BY event_id) AS rn FROM events)
SELECT user_id, event_id, event_type, value FROM e WHERE rn = 1
""")
def first_occurrences(t):
    """Rows that are the first of their key; later ones are seen already."""
    w = Window.partitionBy("user_id", "event_type", "value").orderBy("event_id")
    return t("events").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "event_id", "event_type", "value")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'other' END AS role FROM orders
""")
def rule_cascade(t):
    """The first of ordered rules that holds."""
    tests = [("done", F.col("o_orderstatus") == "F"), ("large", F.col("o_totalprice") > 300000), ("urgent", F.col("o_orderpriority").like("1%"))]
    return joins.cascade(t("orders"), tests, "other", "role").select("o_orderkey", "role")
