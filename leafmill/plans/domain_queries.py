"""Domain operators over rows made from the driver tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import lookup
from leafmill.operators import glyphs, media, menus, models, streams
from leafmill.plans.registry import query
from leafmill.plans.written import KEYS, chunks_of, files_of
from leafmill.sinks import markup
from leafmill.sinks.packages import BREAK, cells
from leafmill.sources import packages as source


def _cells(text):
    def mapped(values):
        return values.map(lambda v: cells(v) if isinstance(v, str) else None)

    return F.pandas_udf(mapped, "binary")(text)


@query("""
WITH c AS (SELECT p_partkey, p_partkey % 256 AS t, ['MENU.DIC', 'COLSCR.BIN', 'Image1', 'PCMDATA.BIN', 'audio', 'MULTI01', 'FKINDEX'][p_size % 7 + 1] AS n FROM part),
r AS (SELECT *, upper(n) AS u,
  t IN (48, 96, 112, 113, 114, 128, 129, 144, 145, 146, 161) AS idx FROM c)
SELECT p_partkey,
  CASE WHEN t = 0 THEN 'body' WHEN t IN (3, 4, 5, 6, 7, 9, 10, 13) THEN 'title' WHEN idx THEN 'index' WHEN u LIKE 'MENU%' THEN 'menu' WHEN u LIKE 'COLSCR%' OR u LIKE 'IMAGE%' THEN 'image_store' WHEN u LIKE 'PCM%' OR u LIKE 'AUDIO%' THEN 'audio_store' WHEN u LIKE 'MULTI%' THEN 'selector' ELSE 'other' END AS toolkit,
  CASE WHEN t = 0 THEN 'body' WHEN t IN (3, 4, 5, 6, 7) THEN 'title' WHEN idx THEN 'index' WHEN u LIKE 'MENU%' THEN 'menu' WHEN u LIKE 'COLSCR%' OR u LIKE 'IMAGE%' THEN 'image_store' WHEN u LIKE 'PCM%' OR u LIKE 'AUDIO%' THEN 'audio_store' WHEN u LIKE 'MULTI%' THEN 'selector' ELSE 'other' END AS menu,
  CASE WHEN t = 0 THEN 'body' WHEN t IN (4, 5, 6, 7) THEN 'title' WHEN idx THEN 'index' WHEN u LIKE 'MENU%' THEN 'menu' WHEN u LIKE 'COLSCR%' OR u LIKE 'IMAGE%' THEN 'image_store' WHEN u LIKE 'PCM%' OR u LIKE 'AUDIO%' THEN 'audio_store' WHEN u LIKE 'MULTI%' THEN 'selector' ELSE 'other' END AS verifier,
  u LIKE 'FK%' OR u LIKE 'FH%' OR u LIKE 'KW%' AS forward
FROM r
""")
def role_assignment(t):
    """Roles of components by type and name under the three rules, and whether an index serves forward searches."""
    names = F.array(*[F.lit(n) for n in ("MENU.DIC", "COLSCR.BIN", "Image1", "PCMDATA.BIN", "audio", "MULTI01", "FKINDEX")])
    rows = t("part").select("p_partkey", (F.col("p_partkey") % 256).alias("t"), F.element_at(names, F.col("p_size") % 7 + 1).alias("n"))
    return rows.select("p_partkey", *[models.role(F.col("t"), F.col("n"), rule).alias(rule) for rule in ("toolkit", "menu", "verifier")], models.index_serves(F.col("n"), "forward").alias("forward"))


@query("""
SELECT p_brand AS package_id, 'BODY.BIN' AS component, op, count(*) * k AS n
FROM part, (VALUES ('09', 1), ('41', 1), ('61', 1), ('04', 3), ('05', 3), ('0a', 3)) AS o(op, k) GROUP BY p_brand, op, k
""")
def package_op_counts(t):
    """Control operators of each package's entries."""
    return streams.op_counts(streams.spans(source.entries(chunks_of(files_of(t))), KEYS), ["package_id", "component"])


@query("""
WITH e AS (SELECT p_brand, length(p_name || ' ' || p_partkey) AS h, length('type ' || p_type) + length('size ' || p_size) AS b FROM part)
SELECT p_brand AS package_id, kind, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
  SELECT p_brand, 'text' AS kind, h + b AS n, 2 * (h + b) AS bytes FROM e UNION ALL SELECT p_brand, 'section', 1, 4 FROM e
  UNION ALL SELECT p_brand, 'break', 3, 6 FROM e UNION ALL SELECT p_brand, 'control', 8, 18 FROM e) GROUP BY p_brand, kind
""")
def package_span_kinds(t):
    """Spans and bytes of each kind in each package's body, padding left out: every other byte of an entry is accounted for."""
    decoded = streams.spans(source.entries(chunks_of(files_of(t))), KEYS)
    return decoded.filter("kind <> 'padding'").groupBy("package_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@query("""
WITH e AS (SELECT p_brand, length(p_name || ' ' || p_partkey) AS h, length('type ' || p_type) + length('size ' || p_size) AS b FROM part)
SELECT p_brand AS package_id, kind, parent, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT p_brand, 'text' AS kind, 'halfwidth' AS parent, h + b AS n FROM e UNION ALL SELECT p_brand, 'inline', 'head', 1 FROM e UNION ALL SELECT p_brand, 'inline', 'none', 3 FROM e
  UNION ALL SELECT p_brand, 'break', 'none', 3 FROM e UNION ALL SELECT p_brand, 'section', 'none', 1 FROM e) GROUP BY p_brand, kind, parent
""")
def document_nodes(t):
    """Nodes of all entries' trees by kind and by the tag that they hang on."""
    nodes = streams.doc_nodes(streams.spans(source.entries(chunks_of(files_of(t))), KEYS), KEYS)
    return nodes.groupBy("package_id", "kind", F.coalesce("parent_tag", F.lit("none")).alias("parent")).agg(F.count("*").alias("n"))


@query("""
SELECT p_brand AS package_id, kind, 'resolved' AS status, count(*) AS n FROM part, (VALUES ('index_body'), ('index_title')) AS k(kind) GROUP BY p_brand, kind
""")
def index_edge_counts(t):
    """Body and title pointers of all index rows as edges of the dereference graph."""
    files = files_of(t)
    comps = source.components(source.catalogs(files), files)
    rows = streams.index_rows(streams.index_leaves(source.pages(chunks_of(files).filter(F.col("ctype").isin(source.INDEX_TYPES)))))
    return models.edge_counts(models.index_edges(rows, comps.select("package_id", "component", "idx", "start_block", "end_block")))


@query("""
SELECT p_brand AS package_id, count(*) AS n FROM part WHERE starts_with(p_name || ' ' || p_partkey, 'red plate') GROUP BY p_brand
""")
def search_candidates(t):
    """Index rows whose key bytes begin with any spelling of a query."""
    leaves = streams.index_leaves(source.pages(chunks_of(files_of(t)).filter(F.col("ctype").isin(source.INDEX_TYPES))))
    return leaves.filter(lookup.matches_candidates(F.col("key_bytes"), "red plate", "forward")).groupBy("package_id").agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS line_idx FROM nation)
SELECT CAST(n_regionkey AS VARCHAR) AS package_id, CAST(line_idx AS INTEGER) AS line_idx, n_name AS label, CAST(n_nationkey AS BIGINT) AS block, CAST(n_nationkey % 7 AS INTEGER) AS "offset",
  n_nationkey = 0 AS is_null, CAST(1 + (CASE WHEN line_idx % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS depth
FROM n
""")
def menu_lines(t):
    """Menus written as streams of nations, a link a line under codes of two levels, decoded again."""
    number = lambda v, k: F.unhex(F.lpad(F.hex(v.cast("long")), 2 * k, "0"))
    numbered = t("nation").withColumn("k", F.expr("row_number() over (partition by n_regionkey order by n_nationkey)"))
    named = numbered.withColumn("label", _cells(F.col("n_name")))
    code = number(1 + F.when(F.col("k") % 2 == 0, 1).otherwise(0), 2)
    # The pointer is binary where one of its digits is no decimal digit; packed decimals otherwise.
    digits = lambda v, n: F.unhex(F.lpad(v.cast("string"), n, "0"))
    line = F.concat(F.lit(b"\x1f\x09"), code, F.lit(b"\x1f\x42\x1f\x04"), F.col("label"), F.lit(b"\x1f\x05\x1f\x62"), digits(F.col("n_nationkey"), 8), digits(F.col("n_nationkey") % 7, 4), F.lit(BREAK))
    stream = named.groupBy(F.col("n_regionkey").cast("string").alias("package_id")).agg(F.array_sort(F.collect_list(F.struct("k", line.alias("b")))).alias("parts"))
    rows = stream.select("package_id", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["b"])).alias("bytes"))
    placed = menus.tree(menus.lines(streams.spans(rows, ["package_id"]), ["package_id"]), ["package_id"])
    each = placed.select("package_id", "line_idx", "depth", F.explode("links").alias("l"))
    return each.select("package_id", "line_idx", "l.label", "l.block", "l.offset", "l.is_null", F.col("depth").cast("int").alias("depth"))


@query("""
WITH r AS (SELECT user_id, event_id, CAST(length(event_type) AS INTEGER) AS depth, lead(length(event_type)) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events)
SELECT user_id, depth, count(*) AS n, CAST(count(*) FILTER (after IS NULL OR after <= depth) AS BIGINT) AS leaves FROM r GROUP BY user_id, depth
""")
def leaf_like_rows(t):
    """Rows of each depth in each list, and how many of them have nothing below."""
    rows = t("events").select("user_id", "event_id", F.length("event_type").alias("depth"))
    return menus.leaf_like(rows, ["user_id"], "event_id").groupBy("user_id", "depth").agg(F.count("*").alias("n"), F.count_if("leaf").alias("leaves"))


@query("""
WITH g AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 5 = 1 THEN '' END AS shown, p_size % 7 = 0 AS entry, p_size % 11 = 0 AS image, p_size % 2 = 0 AS bitmap, p_size % 4 = 0 AS blank,
  CASE WHEN p_partkey % 3 = 0 THEN 'b121' ELSE 'a121' END AS code FROM part)
SELECT p_partkey, CASE WHEN shown IS NOT NULL AND shown <> '' THEN 'unicode' WHEN entry THEN 'entry_backed' WHEN image THEN 'image' WHEN bitmap AND blank THEN 'formatting_helper' WHEN bitmap THEN 'bitmap' WHEN code LIKE 'b%' THEN 'formatting_helper' ELSE 'unresolved' END AS status FROM g
""")
def glyph_resolution(t):
    """How a reader shows each glyph, by the evidence that there is."""
    size = F.col("p_size")
    shown = F.when(size % 5 == 0, F.col("p_name")).when(size % 5 == 1, "")
    code = F.when(F.col("p_partkey") % 3 == 0, "b121").otherwise("a121")
    return t("part").select("p_partkey", glyphs.resolution(shown, size % 7 == 0, size % 11 == 0, size % 2 == 0, size % 4 == 0, code).alias("status"))


@query("""
WITH c AS (SELECT CAST(l_suppkey % 200 AS VARCHAR) AS package_id, CASE l_linenumber % 5 WHEN 0 THEN 'body' WHEN 1 THEN 'title' WHEN 2 THEN 'index' WHEN 3 THEN 'menu' ELSE 'media' END AS role, l_orderkey % 97 > 0 AS ok FROM lineitem),
p AS (SELECT package_id, role, count(*) AS n, count(*) FILTER (ok) AS good FROM c GROUP BY package_id, role),
s AS (SELECT package_id, role, CASE WHEN n = 0 THEN 'n/a' WHEN good = n THEN 'yes' WHEN good = 0 THEN 'no' ELSE 'partial' END AS st FROM p),
w AS (SELECT package_id, coalesce(max(st) FILTER (role = 'body'), 'n/a') AS body, coalesce(max(st) FILTER (role = 'index'), 'n/a') AS indexes, coalesce(max(st) FILTER (role = 'title'), 'n/a') AS titles,
  coalesce(max(st) FILTER (role = 'media'), 'n/a') AS media, coalesce(max(st) FILTER (role = 'menu'), 'n/a') AS menus FROM s GROUP BY package_id),
e AS (SELECT package_id, count(*) FILTER (NOT ok) AS bad FROM c GROUP BY package_id)
SELECT package_id, body, indexes, titles, media, menus,
  CASE WHEN body = 'no' OR indexes IN ('no', 'partial') OR bad > 0 THEN 'red' WHEN media IN ('no', 'partial') THEN 'yellow' ELSE 'green' END AS export_status
FROM w JOIN e USING (package_id)
""")
def capability_matrix(t):
    """Capabilities of packages by the state of their components, and whether they can be exported."""
    kind = F.col("l_linenumber") % 5
    ctype = F.when(kind == 0, 0x00).when(kind == 1, 0x05).when(kind == 2, 0x91).otherwise(0xFF)
    name = F.when(kind == 3, "MENU.DIC").when(kind == 4, "COLSCR.BIN").otherwise("X.BIN")
    comps = t("lineitem").select((F.col("l_suppkey") % 200).cast("string").alias("package_id"), ctype.alias("ctype"), name.alias("component"), F.when(F.col("l_orderkey") % 97 > 0, "ok").otherwise("opaque").alias("status"))
    spark = comps.sparkSession
    edges = spark.createDataFrame([], "package_id string, kind string, method string, to_component string, status string")
    matrix = models.capabilities(comps, edges, spark.createDataFrame([], "package_id string, bytes long, issues long"))
    wanted = models.readiness_profiles(matrix).filter("purpose = 'export'").select("package_id", F.col("status").alias("export_status"))
    return matrix.join(wanted, "package_id").select("package_id", "body", "indexes", "titles", "media", "menus", "export_status")


@query(r"""
WITH b AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN '' WHEN 2 THEN '<section:0001> ' || p_name WHEN 3 THEN '<media:00ff>' WHEN 4 THEN upper(printf('%08x', p_partkey)) ELSE 'QUJD' || p_partkey || 'RR==' END AS body FROM part)
SELECT p_partkey, body = '' OR regexp_full_match(trim(regexp_replace(body, '<section:[0-9A-Fa-f]{4}>|<media:[0-9A-Fa-f]+>', '', 'g')), '|[0-9A-Fa-f]{8,16}|[A-Za-z0-9+/]{6,24}={0,2}') AS useless,
  body <> '' AND NOT regexp_matches(body, '\s') AND length(body) > 1 AS informative FROM b
""")
def body_predicates(t):
    """Which bodies say nothing, and which displays tell their glyph from others."""
    kind = F.col("p_size") % 6
    body = (
        F.when(kind == 0, F.col("p_name")).when(kind == 1, "").when(kind == 2, F.concat(F.lit("<section:0001> "), "p_name")).when(kind == 3, "<media:00ff>")
        .when(kind == 4, F.lpad(F.hex("p_partkey"), 8, "0")).otherwise(F.concat(F.lit("QUJD"), F.col("p_partkey").cast("string"), F.lit("RR==")))
    )
    rows = t("part").select("p_partkey", body.alias("body"))
    return rows.select("p_partkey", lookup.useless_body(F.col("body")).alias("useless"), lookup.informative_display(F.col("body")).alias("informative"))


@query("""
SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, CAST(c_custkey % 1000 AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END AS block FROM customer)
ORDER BY CAST(replace(block, 'x', '') AS BIGINT), c_custkey LIMIT 100
""")
def numeric_text_order(t):
    """The first rows in the numeric order of a text column."""
    block = F.concat((F.col("c_custkey") % 1000).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(""))
    return t("customer").withColumn("block", block).orderBy(*lookup.by_number(["block"]), "c_custkey").limit(100).select("c_custkey", "c_name")


@query("""
SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (3, 5, 7)
""")
def selected_ids(t):
    """Rows whose name is among given ids, whatever its case or prefix."""
    return lookup.selected(t("supplier"), "s_name", ["#000000003", "SUPPLIER#000000005", "supplier#000000007"], "Supplier").select("s_suppkey", "s_name")


@query("""
WITH m AS (SELECT event_id, user_id, regexp_replace(event_type || '.wav', '[^0-9A-Za-z._-]+', '_', 'g') AS stem FROM events)
SELECT user_id, event_id, CASE WHEN ROW_NUMBER() OVER (PARTITION BY user_id, stem ORDER BY event_id) = 1 THEN stem ELSE lpad(CAST(event_id AS VARCHAR), CAST(greatest(5, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0') || '_' || stem END AS file_name FROM m
""")
def media_file_names(t):
    """Names of media files, made unique in each package by their number."""
    rows = t("events").select("user_id", "event_id", F.concat("event_type", F.lit(".wav")).alias("name"), F.lit(b"RIFF").alias("payload"))
    return media.file_names(rows, ["user_id"], "event_id", "name", "payload").select("user_id", "event_id", "file_name")


@query("""
SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS shown FROM events
""")
def json_scalars(t):
    """JSON objects without a display value as compact text."""
    return t("events").select("event_id", markup.scalar_text(F.col("props")).alias("shown"))


@query("""
SELECT o_orderkey, o_orderpriority || chr(10) || 'status ' || o_orderstatus || chr(10) || '・' || o_custkey AS text FROM orders
""")
def markup_import(t):
    """HTML written as body bytes and decoded again."""
    html = F.concat(F.lit("<h3>"), "o_orderpriority", F.lit("</h3><p>status <b>"), "o_orderstatus", F.lit("</b></p><ul><li>"), F.col("o_custkey").cast("string"), F.lit("</li></ul>"))
    rows = t("orders").select("o_orderkey", markup.html_body(html).alias("bytes"))
    return streams.entry_text(streams.spans(rows, ["o_orderkey"]), ["o_orderkey"]).select("o_orderkey", "text")
