"""Packages end to end: written from driver rows, read back as tables, searched and rendered."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.bytes import BLOCK
from leafmill.operators import joins, search, streams
from leafmill.plans.registry import query
from leafmill.plans.written import KEYS, chunks_of, files_of
from leafmill.sources import packages as source
from leafmill.staging import scratch

@query("""
SELECT p_brand AS package_id, p_name || ' ' || p_partkey AS headword, p_name || ' ' || p_partkey || chr(10) || 'type ' || p_type || chr(10) || 'size ' || p_size AS text FROM part
""")
def decode_package(t):
    """Entries of all packages, decoded from their bytes."""
    expanded = chunks_of(files_of(t))
    decoded = streams.spans(source.entries(expanded), KEYS)
    return streams.entry_text(decoded, KEYS).select("package_id", "headword", "text")


@query("""
SELECT p_brand AS package_id, p_name || ' ' || p_partkey AS heading, '<h3 class="head">' || p_name || ' ' || p_partkey || '</h3><br>type ' || p_type || '<br>size ' || p_size || '<br>' AS html FROM part
""")
def render_documents(t):
    """Entries of all packages as HTML, with the heading that their index row's title pointer leads to."""
    expanded = chunks_of(files_of(t))
    cut = source.entries(expanded)
    html = streams.entry_html(streams.spans(cut, KEYS), KEYS)
    at = expanded.select("package_id", "component", "ctype", "start_block").distinct()
    body = cut.join(at, ["package_id", "component"]).select(*KEYS, (F.col("start_block") * BLOCK + F.col("start")).alias("place"))
    rows = streams.index_rows(streams.index_leaves(source.pages(expanded.filter(F.col("ctype").isin(source.INDEX_TYPES)))))
    rows = scratch(rows.select("package_id", (F.col("body.block") * BLOCK + F.col("body.offset")).alias("place"), (F.col("title.block") * BLOCK + F.col("title.offset")).alias("title_place")), "pointers")
    # Title streams are cut where index rows point, so a line is a row and no stream is one.
    titles = expanded.filter(F.col("ctype").isin(source.TITLE_TYPES))
    edges = titles.groupBy("package_id", "component", "start_block").agg(F.sum(F.octet_length("bytes")).alias("size"))
    first = F.col("title_place") - F.col("start_block") * BLOCK
    starts = rows.select("package_id", "title_place").distinct().join(edges, "package_id").filter((first >= 0) & (first < F.col("size"))).select("package_id", "component", first.alias("start"))
    cut_titles = source.slices(titles, starts)
    line = streams.titles(cut_titles, KEYS).filter("start = 0").select(*KEYS, F.col("text").alias("heading"))
    lines = line.join(cut_titles.select(*KEYS, F.col("start").alias("from")), KEYS).join(at, ["package_id", "component"]).select("package_id", (F.col("start_block") * BLOCK + F.col("from")).alias("title_place"), "heading")
    met = rows.join(body, ["package_id", "place"]).join(lines, ["package_id", "title_place"], "left").join(html, KEYS)
    return met.select("package_id", "heading", "html")


@query("""
WITH hits AS (
  SELECT p_brand AS package_id, p_partkey, upper(replace(p_name || p_partkey, ' ', '')) AS k FROM part)
SELECT package_id, count(*) AS n FROM hits WHERE starts_with(k, 'REDPLATE') GROUP BY package_id
""")
def search_packages(t):
    """Rows of all packages' indexes whose key begins with a term."""
    expanded = chunks_of(files_of(t))
    rows = streams.index_rows(streams.index_leaves(source.pages(expanded.filter(F.col("ctype").isin(source.INDEX_TYPES)))))
    key = F.upper(F.regexp_replace("key", r"\s", ""))
    hits = search.search(rows.select("package_id", "key", "body.block", "body.offset"), "key", "red plate", ["forward"], ["package_id", "block", "offset"], None, key, "REDPLATE")
    return hits.groupBy("package_id").agg(F.count("*").alias("n"))


@query("""
SELECT component, status, count(*) AS n FROM (
  SELECT DISTINCT p_brand, unnest(['BODY.BIN', 'TITLE.BIN', 'INDEX.BIN']) AS component, 'resolved' AS status FROM part) GROUP BY ALL
""")
def dereference_packages(t):
    """Index pointers of all packages resolved to the component that holds their block."""
    files = files_of(t)
    comps = source.components(source.catalogs(files), files).select("package_id", "idx", "component", "start_block", "end_block")
    rows = streams.index_rows(streams.index_leaves(source.pages(chunks_of(files).filter(F.col("ctype").isin(source.INDEX_TYPES)))))
    points = rows.select("package_id", F.explode(F.array("body.block", "title.block")).alias("block")).distinct().unionByName(comps.filter("component = 'INDEX.BIN'").select("package_id", F.col("start_block").alias("block")))
    met = joins.first_containing(points, comps, "package_id", "block", "start_block", "end_block", "idx", ["component"], 64)
    status = F.when(F.col("component").isNull(), "unresolved").otherwise("resolved")
    return met.select("package_id", "component", status.alias("status")).distinct().groupBy("component", "status").agg(F.count("*").alias("n"))


@query()
def byte_coverage(t):
    """Spans, bytes and issues of each body stream: the bytes are those of the stream, whatever it holds."""
    expanded = chunks_of(files_of(t))
    cut = source.entries(expanded)
    decoded = streams.coverage(streams.spans(cut, KEYS), KEYS)
    return decoded.join(cut.select(*KEYS, (F.col("end") - F.col("start")).alias("length")), KEYS)
