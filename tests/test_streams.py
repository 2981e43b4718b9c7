"""Tokens, entries, titles and index rows against bytes made by hand and by the writer."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import streams
from tests import whole as sink
from leafmill.sources import packages as source

KEYS = ["package_id", "component", "entry_idx"]


def spans(spark, data, glyphs=None):
    df = spark.createDataFrame([("p", "BODY", 1, bytearray(data))], "package_id string, component string, entry_idx int, bytes binary")
    return streams.spans(df, KEYS, glyphs=glyphs).orderBy("span").collect()


@pytest.mark.parametrize("data, kinds", [
    (b"\x00\x00\x1f\x09\x00\x01\x1f\x0a", ["padding", "section", "break"]),
    (b"\x23\x61\x23\x62", ["text", "text"]),
    (b"A\x00", ["ascii", "padding"]),
    (b"\xb1\x21\xa1", ["glyph", "glyph"]),
    (b"\x1f\x4a\x00\x00" + bytes(12), ["control"]),
    (b"\x1f\x4a\x00\x01" + bytes(14), ["control"]),
    (b"\x1f\x4a\x00\x05", ["control"]),
    (b"\x1f\x4e\x01\x00" + bytes(38), ["control"]),
    (b"\x1f\x4f\x1f\x6f" + bytes(46), ["control"]),
    (b"\x1f\x4f\x01\x02" + bytes(32), ["control"]),
    (b"\x1f\x4d" + bytes(18), ["media_ref"]),
    (b"\x1f\x99\x23\x61", ["unknown_control", "text"]),
    (b"\x1f\x4d\x00\x01\x23\x61", ["media_ref"]),
    (b"\x1f", ["problem"]),
    (b"\x11\x03\n\x80", ["control", "break", "problem"]),
])
def test_tokens(spark, data, kinds):
    got = spans(spark, data)
    assert [r["kind"] for r in got] == kinds
    assert [r["start"] for r in got] == [0, *[r["end"] for r in got[:-1]]] and got[-1]["end"] == len(data)


def test_issues_and_depths(spark):
    got = spans(spark, b"\x1f\x05\x1f\x04\x23\x61\x1f\x05\x23\x61\x1f\xe2\x00\x00\x23\x62\x1f\xe3\x23\x63\x1f\x4d\x00")
    assert [r["normalized"] for r in got if r["kind"] == "text"] == ["a", "ａ", "ｂ", "ｃ"]
    assert [r["hidden"] for r in got if r["kind"] == "text"] == [False, False, True, False]
    assert got[-1]["issue"] == "truncated_control"


def test_random_bytes_are_covered(spark):
    draw = random.Random(4)
    rows = [("p", "BODY", k, bytearray(bytes(draw.choice([0, 0x1F, 0x4A, 0x4E, 0x21, 0x41, 0xB0, 0x0A, 0x9F, draw.randrange(256)]) for _ in range(draw.randint(1, 300))))) for k in range(40)]
    df = spark.createDataFrame(rows, "package_id string, component string, entry_idx int, bytes binary")
    got = {r["entry_idx"]: r["bytes"] for r in streams.coverage(streams.spans(df, KEYS), KEYS).collect()}
    assert got == {r[2]: len(r[3]) for r in rows}


def test_glyphs(spark):
    glyphs = spark.createDataFrame([("p", "b121", "é")], "package_id string, code string, display string")
    decoded = spark.createDataFrame([("p", "BODY", 1, bytearray(b"\xb1\x21\xa1\x22\xb1\x22"))], "package_id string, component string, entry_idx int, bytes binary")
    row = streams.entry_text(streams.spans(decoded, KEYS, glyphs=glyphs), KEYS).first()
    assert row["text"] == "é<hA122><zB122>"


def test_cells_match_the_codecs(spark):
    table = {r["cell"]: r["char"] for r in streams.cell_table(spark).collect()}
    assert table["2361"] == "ａ" and table["3021"] == "亜"
    assert len(table) > 6800
    for code, char in table.items():
        if len(char) == 1 and char in "あア漢字Ａ１":
            assert bytes.fromhex(code) in char.encode("iso2022_jp")


def test_tagged_leaf_and_groups_across_pages(spark):
    row = lambda tag, key, body, title: bytes([tag, len(key)]) + key + body.to_bytes(4, "big") + b"\0\1" + title.to_bytes(4, "big") + b"\0\2"
    head = lambda key, n: bytes([0x80, len(key)]) + n.to_bytes(2, "big") + key
    a, b, c = (sink.cells(x) for x in "abc")
    page = lambda *rows: (b"\x80\x00" + len(rows).to_bytes(2, "big") + b"".join(rows)).ljust(2048, b"\0")
    pages = [page(row(0xC0, a, 5, 6), head(b, 7), row(0xC0, c, 8, 9)), page(row(0xC0, a, 1, 2), row(0, c, 3, 4)), page(row(0, a, 1, 1), b"\x33\x05junk!")]
    df = spark.createDataFrame([("p", "I", 0x90, k, bytearray(p)) for k, p in enumerate(pages)], "package_id string, component string, ctype int, page_idx int, page binary")
    got = streams.index_rows(streams.index_leaves(df)).orderBy("page_idx", "row_idx").collect()
    assert [(r["key"], r["target_key"], r["tagged"], r["continued"], r["count_hint"]) for r in got] == [
        ("a", "a", True, True, None), ("b", "c", True, False, 7), ("b", "a", True, False, 7), ("c", "c", False, False, None), ("a", "a", False, False, None)]
    assert got[1]["body"]["block"] == 8 and got[1]["title"]["offset"] == 2


def build(spark, n, long=1):
    entries = [(f"word {k}", f"first line {k}\n" + "second line " * long) for k in range(n)]
    files = [(d, name, bytearray(c)) for d, name, c in sink.build("pkg", "Title", entries)]
    return entries, spark.createDataFrame(files, "dir string, name string, content binary")


def test_round_trip_over_chunks(spark):
    entries, files = build(spark, 60, 60)
    comps = source.components(source.catalogs(files), files)
    assert {r["component"]: r["status"] for r in comps.collect()} == {"BODY.BIN": "ok", "TITLE.BIN": "ok", "INDEX.BIN": "ok"}
    expanded = source.chunks(comps).cache()
    assert expanded.filter("component = 'BODY.BIN'").count() > 2
    cut = source.entries(expanded)
    got = streams.entry_text(streams.spans(cut, KEYS), KEYS).orderBy("entry_idx").collect()
    assert [(r["headword"], r["text"]) for r in got] == [(h, (h + "\n" + t).strip()) for h, t in entries]
    rows = streams.index_rows(streams.index_leaves(source.pages(expanded.filter("ctype = 145")))).collect()
    assert sorted(r["key"] for r in rows) == sorted(h for h, _ in entries)
    titles = source.slices(expanded.filter("ctype = 5"), expanded.filter("false").selectExpr("package_id", "component", "cast(0 as bigint) start"))
    assert [r["text"] for r in streams.titles(titles, KEYS).orderBy("line_idx").collect()] == [h for h, _ in entries]


def test_marks_across_chunks_and_leads(spark):
    mark, lead = source.ENTRY_MARK, source.ENTRY_LEAD
    body = bytearray(b"\x23\x61" * 40_000)
    places = [0, 2, 32767 - 1, 32768 + 1000, 65536 - 2]
    for p in places:
        body[p : p + 4] = mark
    body[32768 + 998 : 32768 + 1000] = lead
    rows = [("p", "B", k, bytearray(body[k * 32768 : (k + 1) * 32768])) for k in range(3)]
    df = spark.createDataFrame(rows, "package_id string, component string, chunk_idx int, bytes binary")
    got = sorted(r["start"] for r in source.marks(df, mark, lead).collect())
    assert got == sorted({body.find(mark, p) - (2 if body[p - 2 : p] == lead and p else 0) for p in places if body[p : p + 4] == mark})


def test_copies_from_the_window(spark):
    # Two literals, then a copy of both of them from the ring, then one more literal.
    raw = bytes(2) + (3).to_bytes(2, "big") + b"\0" + bytes((0, 0, 65)) + bytes((0, 0, 66)) + bytes(((4078 >> 4), (4078 & 15) << 4 | 2, 67))
    got = spark.createDataFrame([(bytearray(raw),)], "raw binary").select(source.expand(F.col("raw")).alias("b")).first()["b"]
    assert bytes(got) == b"ABABC"


def test_broken_files_are_rows(spark):
    _, files = build(spark, 2)
    broken = files.filter("name <> 'TITLE.BIN'").withColumn("content", F.when(F.col("name") == "INDEX.BIN", F.lit(b"cipher")).otherwise(F.col("content")))
    more = spark.createDataFrame([("q", "BAD.IDX", bytearray(source.CATALOG_MAGIC + bytes(200)))], "dir string, name string, content binary")
    listed = broken.unionByName(more)
    cats = source.catalogs(listed)
    assert {r["package_id"]: r["status"] for r in cats.collect()} == {"pkg": "ok", "q": "bad_catalog"}
    assert {r["component"]: r["status"] for r in source.components(cats, listed).collect()} == {"BODY.BIN": "ok", "TITLE.BIN": "missing", "INDEX.BIN": "opaque"}


POINT = lambda block, at: block.to_bytes(4, "big") + at.to_bytes(2, "big")


@pytest.mark.parametrize("ctype, records, want", [
    (0x60, [b"\x02\x23\x61" + POINT(3, 4)], [("a", "a", 3, 3, None, False)]),
    (0x30, [b"\x80\x02\x00\x05\x23\x61", b"\xc0\x02\x23\x62" + POINT(7, 8)], [("a", "b", 7, 7, 5, False)]),
    (0x80, [b"\xc0" + POINT(1, 1), b"\x80\x02" + (9).to_bytes(4, "big") + b"\x23\x61" + POINT(50, 2), b"\xb0" + POINT(6, 1), b"\x00\x02\x23\x62" + POINT(2, 2) + POINT(3, 3)],
     [("", "", 1, 1, None, True), ("a", "a", 6, 50, 9, False), ("b", "b", 2, 3, None, False)]),
    (0x81, [b"\x80\x02" + (9).to_bytes(4, "big") + b"\x23\x61" + POINT(50, 2), b"\xc0" + POINT(6, 1), b"\xb0" + POINT(6, 2)], [("a", "a", 6, 50, 9, False)]),
    (0xA1, [b"\x80\x02" + (2).to_bytes(4, "big") + b"\x23\x61", b"\xc0" + POINT(6, 1) + POINT(7, 1)], [("a", "a", 6, 7, 2, False)]),
])
def test_other_leaf_grammars(spark, ctype, records, want):
    page = (b"\x80\x00" + len(records).to_bytes(2, "big") + b"".join(records)).ljust(2048, b"\0")
    df = spark.createDataFrame([("p", "I", ctype, 0, bytearray(page))], "package_id string, component string, ctype int, page_idx int, page binary")
    leaves = streams.index_leaves(df)
    got = streams.index_rows(leaves).orderBy("row_idx").collect()
    assert [(r["key"], r["target_key"], r["body"]["block"], r["title"]["block"], r["count_hint"], r["continued"]) for r in got] == want
    account = streams.page_accounting(df, leaves).first()
    assert account["stated"] == len(records) and (account["issue"] == "short_page") == (ctype == 0x81)


def test_doc_nodes(spark):
    data = b"\x1f\x41\x00\x00\x23\x61\x1f\x10\x23\x62\x1f\x11\x23\x63\x1f\x61\x1f\x0a\x23\x64\x1f\xe2\x00\x00\x23\x65\x1f\xe3"
    df = spark.createDataFrame([("p", "BODY", 1, bytearray(data))], "package_id string, component string, entry_idx int, bytes binary")
    got = streams.doc_nodes(streams.spans(df, KEYS), KEYS).orderBy("node_id").collect()
    assert [(r["node_id"], r["parent_id"], r["kind"], r["tag"], r["text"]) for r in got if r["kind"] != "control"] == [
        (1, 0, "inline", "head", None), (2, 1, "text", None, "ａ"), (3, 1, "inline", "italic", None), (4, 3, "text", None, "ｂ"), (6, 1, "text", None, "ｃ"), (8, 0, "break", None, "\n"), (9, 0, "text", None, "ｄ")]


def test_doc_nodes_at_any_depth(spark):
    deep = 40
    data = b"".join(b"\x1f\x10\x23\x61" for _ in range(deep)) + b"\x1f\x11" * deep + b"\x23\x62"
    df = spark.createDataFrame([("p", "BODY", 1, bytearray(data)), ("p", "BODY", 2, bytearray(b"\x23\x61"))], "package_id string, component string, entry_idx int, bytes binary")
    got = {(r["entry_idx"], r["node_id"]): r["parent_id"] for r in streams.doc_nodes(streams.spans(df, KEYS), KEYS).collect()}
    # Start k is node 2k + 1, its text node 2k + 2; a start hangs on the one before, its text on it.
    want = {(1, 2 * k + 1): 2 * k - 1 if k else 0 for k in range(deep)} | {(1, 2 * k + 2): 2 * k + 1 for k in range(deep)} | {(1, 3 * deep + 1): 0, (2, 1): 0}
    assert got == want


def test_strict_decoding_gives_errors_as_rows(spark):
    df = spark.createDataFrame([("p", "B", 1, bytearray(b"\x23\x61")), ("p", "B", 2, bytearray(b"\x23\x61\x1f\x4d\x00"))], "package_id string, component string, entry_idx int, bytes binary")
    decoded = streams.spans(df, KEYS)
    good, errors = streams.strict(decoded, KEYS)
    assert {r["entry_idx"] for r in good.collect()} == {1}
    assert [(r["entry_idx"], r["start"], r["issue"]) for r in errors.collect()] == [(2, 2, "truncated_control")]
    assert streams.checked(good).count() == good.count()
    with pytest.raises(Exception, match="truncated_control at 2"):
        streams.checked(decoded).collect()
