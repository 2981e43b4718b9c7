"""Aggregation and sequence operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.operators import aggregates, ranks, windows
from leafmill.plans.registry import query

SECONDS = "cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint)"
SECONDS_SQL = "CAST(floor(epoch(ts)) AS BIGINT)"


@query("""
SELECT 'k' AS key, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS n FROM events
""")
def counter_merge(t):
    """Counters of all events' JSON maps added up."""
    return aggregates.merged_counters(t("events").select(F.from_json("props", "map<string,bigint>").alias("m")), "m")


@query("""
SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS long_docs, max(n_chars) AS longest
FROM documents GROUP BY lang, source
""")
def corpus_profile(t):
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 5000).alias("long_docs"), F.max("n_chars").alias("longest"))


@query("""
WITH b AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
c AS (SELECT event_type, prev, count(*) AS n FROM b GROUP BY ALL)
SELECT event_type, prev, n, CAST(place AS INTEGER) AS place FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY n DESC, prev NULLS FIRST) AS place FROM c) WHERE place <= 3
""")
def op_atlas(t):
    """Each event type's three commonest predecessors."""
    rows = windows.with_previous(t("events"), "user_id", ["ts", "event_id"], "event_type", "prev")
    return aggregates.top_sub_histogram(rows, "event_type", "prev", 3)


_FLAG_SQL = """
WITH f AS (
  SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS bucket,
    CAST(l_quantity AS BIGINT) AS q, unnest(list_filter([CASE WHEN l_discount > 0.08 THEN 'discounted' END, CASE WHEN l_tax = 0 THEN 'untaxed' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END, 'any'], lambda x: x IS NOT NULL)) AS flag
  FROM lineitem)
SELECT bucket, flag, count(*) AS n, CAST(sum(q) AS BIGINT) AS occurrences FROM f GROUP BY bucket, flag
"""


@query(_FLAG_SQL)
def bucket_flag_summary(t):
    """Rows and quantities of each bucket and each of its flags."""
    q = F.col("l_quantity")
    bucket = F.when(q < 10, "small").when(q < 30, "medium").otherwise("large")
    flags = F.array_compact(F.array(F.when(F.col("l_discount") > 0.08, "discounted"), F.when(F.col("l_tax") == 0, "untaxed"), F.when(F.col("l_returnflag") == "R", "returned"), F.lit("any")))
    return t("lineitem").select(bucket.alias("bucket"), q.cast("long").alias("q"), F.explode(flags).alias("flag")).groupBy("bucket", "flag").agg(F.count("*").alias("n"), F.sum("q").alias("occurrences"))


@query("""
WITH b AS (
  SELECT concat_ws(';', CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_nationkey % 7 = 0 THEN 'region' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END) AS blockers FROM customer)
SELECT blocker, count(*) AS n FROM (SELECT unnest(string_split(blockers, ';')) AS blocker FROM b) WHERE blocker <> '' GROUP BY blocker
""")
def blocker_counts(t):
    """Blockers joined by semicolons, taken apart and counted."""
    joined = F.concat_ws(";", F.when(F.col("c_acctbal") < 0, "debt"), F.when(F.col("c_nationkey") % 7 == 0, "region"), F.when(F.col("c_mktsegment") == "BUILDING", "segment"))
    return t("customer").select(F.explode(F.split(joined, ";")).alias("blocker")).filter("blocker <> ''").groupBy("blocker").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT c_nationkey, CASE WHEN c_acctbal < -900 THEN 'no' WHEN c_acctbal < 0 THEN 'unknown' WHEN c_acctbal < 1000 THEN 'partial' WHEN c_acctbal < 2000 THEN 'n/a' ELSE 'yes' END AS status FROM customer)
SELECT c_nationkey, max_by(status, list_position(['yes', 'n/a', 'partial', 'unknown', 'no'], status)) AS worst_status FROM s GROUP BY c_nationkey
""")
def worst_status(t):
    b = F.col("c_acctbal")
    status = F.when(b < -900, "no").when(b < 0, "unknown").when(b < 1000, "partial").when(b < 2000, "n/a").otherwise("yes")
    return aggregates.worst(t("customer").select("c_nationkey", status.alias("status")), "c_nationkey", "status", aggregates.CAPABILITY)


@query("""
WITH g AS (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_partkey, arg_max(q, (n, -q)) AS mode_value, max(n) AS mode_count FROM g GROUP BY l_partkey
""")
def mode_with_tie(t):
    """The commonest quantity of each part, the smallest of equals."""
    return aggregates.mode(t("lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("q")), "l_partkey", "q")


@query("""
SELECT p_brand, list_sort(list(p_size))[len(list(p_size)) // 2 + 1] AS upper_median, count(*) AS n_values FROM part GROUP BY p_brand
""")
def upper_median(t):
    return aggregates.upper_median(t("part"), "p_brand", "p_size")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
SELECT user_id, round(-sum(n / total * log2(n / total)), 9) AS entropy, CAST(max(total) AS BIGINT) AS total FROM s GROUP BY user_id
""")
def entropy(t):
    return aggregates.entropy(t("events"), "user_id", "event_type").withColumn("entropy", F.round("entropy", 9))


@query("SELECT count(*) - count(DISTINCT text) AS duplicates, count(*) AS n FROM documents")
def duplicate_count(t):
    """Texts over the number of different texts, by their digests."""
    keyed = t("documents").select(F.sha2("text", 256).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return keyed.agg((F.sum("n") - F.count_if(F.col("k").isNotNull())).alias("duplicates"), F.sum("n").alias("n"))


@query("""
SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders) WHERE place <= 3
""")
def bounded_samples(t):
    return aggregates.samples(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey", "place")


@query("""
SELECT p_name, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS brands, count(*) AS n FROM part GROUP BY p_name
""")
def merge_duplicates(t):
    """Parts of one name merged: their brands, once each."""
    return t("part").groupBy("p_name").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), "|").alias("brands"), F.count("*").alias("n"))


@query("""
SELECT l_suppkey, CAST(sum(l_quantity) FILTER (WHERE l_returnflag IN ('A', 'R')) AS BIGINT) AS coverage_back, CAST(sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS coverage_open, count(*) AS n FROM lineitem GROUP BY l_suppkey
""")
def conditional_sums(t):
    q = F.col("l_quantity")
    return t("lineitem").groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag").isin("A", "R"), q)).cast("long").alias("coverage_back"), F.sum(F.when(F.col("l_linestatus") == "O", q)).cast("long").alias("coverage_open"), F.count("*").alias("n"))


@query(f"""
WITH m AS (SELECT DISTINCT user_id, {SECONDS_SQL} AS start_s FROM events WHERE event_type = 'signup'), e AS (SELECT user_id, max({SECONDS_SQL}) + 1 AS end_s FROM events GROUP BY 1)
SELECT m.user_id, start_s, COALESCE(lead(start_s) OVER (PARTITION BY m.user_id ORDER BY start_s), end_s) AS slice_end, CAST(ROW_NUMBER() OVER (PARTITION BY m.user_id ORDER BY start_s) AS INTEGER) AS slice
FROM m JOIN e ON m.user_id = e.user_id
""")
def boundary_slices(t):
    """Each user's time cut at sign-ups."""
    events = t("events").select("user_id", "event_type", F.expr(SECONDS).alias("start_s"))
    ends = events.groupBy("user_id").agg((F.max("start_s") + 1).alias("end_s"))
    return windows.slices(events.filter("event_type = 'signup'"), "user_id", "start_s", ends, "end_s")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events
""")
def forward_fill(t):
    """The last purchase's value carried to what follows."""
    return windows.filled(t("events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "carried").select("event_id", "user_id", "carried")


@query("""
WITH s AS (SELECT event_id, user_id, ts, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER w AS BIGINT) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS depth FROM s
""")
def clipped_depth(t):
    """Clicks open, views close; the depth never falls below zero."""
    step = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    return windows.clipped_depth(t("events"), "user_id", ["ts", "event_id"], step).select("event_id", "user_id", "depth")


@query("""
WITH d AS (SELECT p_brand, p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) AS INTEGER) AS depth FROM part)
SELECT p_brand, p_partkey, depth, COALESCE(lead(depth) OVER (PARTITION BY p_brand ORDER BY p_partkey) <= depth, true) AS leaf FROM d
""")
def section_rank_depth(t):
    """Rank of a code among its group's codes as a depth; a row is a leaf if the next isn't deeper."""
    ranked = t("part").withColumn("depth", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_type")))
    ahead = F.lead("depth").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return ranked.select("p_brand", "p_partkey", "depth", F.coalesce(ahead <= F.col("depth"), F.lit(True)).alias("leaf"))


_SPANS_SQL = """
WITH s AS (SELECT o_custkey, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 20 + o_orderkey % 30 AS b FROM orders),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT o_custkey, min(a) AS island_start, max(b) AS island_end FROM i GROUP BY o_custkey, island)
"""


def _spans(t):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return t("orders").select("o_custkey", day.alias("a"), (day + 20 + F.col("o_orderkey") % 30).alias("b"))


@query(_SPANS_SQL + "SELECT o_custkey, island_start, island_end FROM m")
def merge_intervals(t):
    """Order intervals of each customer merged into islands."""
    return windows.islands(_spans(t), "o_custkey", "a", "b")


@query(_SPANS_SQL + """, g AS (
  SELECT o_custkey, COALESCE(lag(island_end) OVER (PARTITION BY o_custkey ORDER BY island_start) + 1, 0) AS gap_start, island_start - 1 AS gap_end FROM m
  UNION ALL SELECT o_custkey, max(island_end) + 1, 5000 FROM m GROUP BY o_custkey)
SELECT o_custkey, gap_start, gap_end FROM g WHERE gap_start <= gap_end""")
def uncovered_gaps(t):
    """What the islands leave of days 0 to 5000."""
    return windows.gaps(_spans(t), "o_custkey", F.lit(0).cast("long"), F.lit(5000).cast("long"), "a", "b")


@query(f"""
WITH e AS (SELECT *, {SECONDS_SQL} AS place FROM events), w AS (
  SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'error' THEN place END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY place RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS error_at FROM e)
SELECT event_id, user_id, error_at FROM w WHERE event_type = 'purchase'
""")
def preceding_within_range(t):
    """The last error in the hour before each purchase."""
    rows = t("events").select("event_id", "user_id", "event_type", F.expr(SECONDS).alias("at"))
    made = windows.preceding_within(rows, "user_id", "at", 3600, F.when(F.col("event_type") == "error", F.col("at")), "error_at")
    return made.filter("event_type = 'purchase'").select("event_id", "user_id", "error_at")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50
""")
def hotspots_top50(t):
    order = [F.desc("l_quantity"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t("lineitem").orderBy(*order).limit(50).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""
SELECT doc_id, CAST(spent AS BIGINT) AS spent FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS spent, (SELECT sum(n_chars) FROM documents) AS total FROM documents) WHERE spent * 2 <= total
""")
def scan_budget(t):
    """Documents in order of id until half of all characters are spent."""
    docs = t("documents").select("doc_id", "n_chars")
    spent = ranks.running(docs, "doc_id", None, {"spent": F.col("n_chars")})
    total = docs.agg(F.sum("n_chars")).first()[0] or 0
    return spent.filter(F.col("spent") * 2 <= total).select("doc_id", "spent")


@query("""
WITH r AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, len(lines) AS n_lines, lines[1] AS first_line, (len(lines) + 4) // 5 AS groups FROM r
""")
def fixed_stride_groups(t):
    """Non-empty lines in groups of five."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return t("documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.get(lines, F.lit(0)).alias("first_line"), F.floor((F.size(lines) + 4) / 5).cast("long").alias("groups"))


@query("""
WITH a AS (SELECT *, 1 + CASE WHEN conv_id IS NULL THEN NULL ELSE turn % 3 END AS depth FROM conversations),
u AS (SELECT conv_id, turn, depth, role,
  max(CASE WHEN depth <= 1 THEN turn END) OVER w AS t1, max(CASE WHEN depth <= 2 THEN turn END) OVER w AS t2 FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT u.*, x.depth AS d1, x.role AS r1, y.depth AS d2, y.role AS r2 FROM u LEFT JOIN a x ON x.conv_id = u.conv_id AND x.turn = t1 LEFT JOIN a y ON y.conv_id = u.conv_id AND y.turn = t2)
SELECT conv_id, turn, depth, concat_ws('/', CASE WHEN d1 = 1 THEN r1 END, CASE WHEN depth >= 2 AND d2 = 2 THEN r2 END, CASE WHEN depth = 3 THEN role END) AS path FROM n
""")
def ancestor_paths(t):
    """Roles on the way from the top to each turn, of which every third is at the top.

    Turns may repeat, so the ancestors are met by their place: each row at that place is one.
    """
    turns = t("conversations").withColumn("depth", F.when(F.col("conv_id").isNotNull(), 1 + F.col("turn") % 3))
    placed = windows.places_above(turns.select("conv_id", "turn", "depth", "role"), "conv_id", "turn", "depth", 2)
    for d in (1, 2):
        above = turns.select(F.col("conv_id").alias("c_"), F.col("turn").alias("t_"), F.col("depth").alias(f"d{d}"), F.col("role").alias(f"r{d}"))
        placed = placed.join(above, (F.col("conv_id") == F.col("c_")) & (F.col(f"above_{d}") == F.col("t_")), "left").drop("c_", "t_")
    steps = F.when(F.col("d1") == 1, F.col("r1")), F.when((F.col("depth") >= 2) & (F.col("d2") == 2), F.col("r2")), F.when(F.col("depth") == 3, F.col("role"))
    return placed.select("conv_id", "turn", "depth", F.concat_ws("/", *steps).alias("path"))
