"""Resources, sidecars, media, menus, glyphs and verification on bytes made by hand."""

import io
import json
import plistlib
import sqlite3
import zipfile

from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import glyphs, media, menus, streams, verify
from tests import whole as sink
from leafmill.sources import packages as source
from leafmill.sources import reports, resources, sqlite

KEYS = ["package_id", "component", "entry_idx"]
be = lambda v, n: v.to_bytes(n, "big")


def files(spark, *rows):
    return spark.createDataFrame([(d, n, bytearray(c)) for d, n, c in rows], "dir string, name string, content binary")


def decoded(spark, data):
    return streams.spans(spark.createDataFrame([("p", "C", 1, bytearray(data))], "package_id string, component string, entry_idx int, bytes binary"), KEYS)


def units(s):
    return s.encode("utf-16-be").ljust(4, b"\0")


def test_glyph_maps_in_three_layouts(spark):
    rec = lambda code, d, f="", g=None: be(code, 2) + b"\0\0" + units(d) + units(f) + (units(g) if g is not None else b"")
    versioned = b"Ver2  " + be(2, 4) + rec(0xA121, "é", "e", "") + rec(0xA121, "è", "", "") + be(1, 4) + rec(0xB121, "😀", "", "x")
    single = be(1, 4) + rec(0xA122, "a")
    double = be(1, 4) + rec(0xA123, "") + be(1, 4) + rec(0xB123, "z", "y")
    broken = be(9, 4) + b"x" * 20
    got = resources.glyph_map(files(spark, ("v", "m", versioned), ("s", "m", single), ("d", "m", double), ("b", "m", broken), ("e", "m", b"")))
    rows = {(r["package_id"], r["section"], r["record_idx"]): (r["code"], r["display"], r["fallback"], r["legacy"]) for r in got.collect()}
    assert rows == {("v", "half", 0): ("a121", "é", "e", ""), ("v", "half", 1): ("a121", "è", "", ""), ("v", "full", 2): ("b121", "😀", "", "x"), ("s", "half", 0): ("a122", "a", "", ""), ("d", "half", 0): ("a123", "", "", ""), ("d", "full", 1): ("b123", "z", "y", "")}
    assert {(r["package_id"], r["code"]): r["display"] for r in resources.glyph_displays(got).collect()} == {("v", "a121"): "è", ("v", "b121"): "😀", ("s", "a122"): "a", ("d", "b123"): "z"}


def test_plists_first_file_wins(spark):
    a, b = plistlib.dumps({"A121": "x", "zz": "no", "b122": 5}), plistlib.dumps({"a121": "y", "A123": "z"})
    got = resources.plist_map(files(spark, ("p", "1.plist", a), ("p", "2.plist", b), ("p", "3.plist", b"<bad")))
    assert {r["code"]: r["display"] for r in got.collect()} == {"a121": "x", "a123": "z"}


def test_bitmaps_and_choice(spark):
    head = bytes(8) + bytes([9, 2]) + be(0xA17D, 2) + be(3, 2)
    data = head.ljust(2048, b"\0") + b"\1\2\3\4" + bytes(4) + b"\xff\x80\xff\x80"
    got = resources.bitmaps(files(spark, ("p", "G1", data), ("p", "G0", head.ljust(2048, b"\0") + bytes(12))))
    assert [(r["code"], r["blank"]) for r in got.filter("resource = 'G1'").orderBy("glyph_idx").collect()] == [("a17d", False), ("a17e", True), ("a221", False)]
    best = {r["code"]: r["resource"] for r in resources.chosen_bitmap(got).collect()}
    assert best == {"a17d": "G1", "a17e": "G0", "a221": "G1"}
    png = got.filter("code = 'a221' and resource = 'G1'").select(media.glyph_png(F.col("width"), F.col("height"), F.col("glyph")).alias("p")).first()["p"]
    assert bytes(png).startswith(b"\x89PNG\r\n\x1a\n") and b"IEND" in bytes(png)


def test_alternate_strings(spark):
    rec = lambda code, v: be(code, 2) + v.ljust(60, b"\0")
    head = lambda n: b"SDICALTH" + bytes(2) + be(0xA17E, 2) + be(n, 2) + bytes(2)
    good, bad = head(2) + rec(0xA17E, b"one") + rec(0xA221, "二".encode("cp932")), head(1) + rec(0xA121, b"x")
    got = resources.alternate_strings(files(spark, ("g", "t", good), ("b", "t", bad)))
    assert sorted((r["package_id"], r["value"], r["status"]) for r in got.collect()) == [("b", "x", "bad_sequence"), ("g", "one", "ok"), ("g", "二", "ok")]


def test_dense_anchors(spark):
    anchor = lambda digits: b"\x1f\x09\x00\x01\x1f\x41\x00\x00\x1f\x04" + b"".join(b"\x21\x21" if d == " " else b"\x23" + d.encode() for d in digits) + b"\x1f\x05"
    data = anchor("    1234").ljust(32, b"\0") + (b"\1\2" + anchor("00000042")).ljust(32, b"\0") + anchor("      x4".replace("x", "a")).ljust(32, b"\0") + anchor(" " * 8).ljust(32, b"\0")
    df = spark.createDataFrame([("p", "B", 0, 5, 0, bytearray(bytes(2048 - 64) + data))], "package_id string, component string, ctype int, start_block long, chunk_idx int, bytes binary")
    got = resources.dense_anchors(df).orderBy("record_idx").collect()
    assert [(r["data_id"], r["block"], r["offset"], r["marker_block"], r["marker_offset"]) for r in got] == [(1234, 5, 1984, 5, 1984), (42, 5, 2016, 5, 2018)]


def test_selectors(spark):
    ref = lambda kind, block: bytes([kind, 1]) + be(block, 4) + be(7, 4) + bytes(6)
    rec = lambda label, refs: bytes([len(refs), 3]) + sink.cells(label).ljust(30, b"\0") + b"".join(refs)
    data = be(2, 2) + bytes(14) + rec("ab", [ref(0x91, 5), ref(0x05, 6)]) + rec("c", [])
    got = resources.selectors(files(spark, ("p", "SEL", data))).orderBy("idx", "ref_idx").collect()
    assert [(r["idx"], r["label"], r["ref_idx"], r["ctype"], r["start_block"]) for r in got] == [(1, "ab", 0, 0x91, 5), (1, "ab", 1, 5, 6), (2, "c", None, None, None)]


def test_aux_index_and_line_files(spark):
    body = "0000000A\t00000001\tRoot\n0000000B\tFFFF\tbad\n0000000B\t00000002\t\tChild &amp; co\nno\n0000000C\t00000003\t\t\tLeaf\n0000000D\t00000004\tNext\n"
    lines = resources.text_lines(files(spark, ("p", "x.idx", body.encode("cp932"))), "cp932")
    got = resources.aux_index(lines).orderBy("line_no").collect()
    assert [(r["block"], r["depth"], r["path"]) for r in got] == [(10, 1, ["Root"]), (11, 2, ["Root", "Child & co"]), (12, 3, ["Root", "Child & co", "Leaf"]), (13, 1, ["Next"])]
    five = resources.five_line_records(resources.text_lines(files(spark, ("p", "t", b"1\r\nT\nD\nA\nI\n\n2\nU\n"))))
    assert [(r["id"], r["image"], r["status"]) for r in five.orderBy("record").collect()] == [("1", "I", "ok"), ("2", None, "truncated")]
    times, texts = (resources.text_lines(files(spark, ("p", n, c))) for n, c in (("a", b"0:01.5\n0:02"), ("b", b"one\ntwo")))
    zipped = resources.parallel_lines(times, texts, text.milliseconds)
    assert [(r["ms"], r["line"]) for r in zipped.orderBy("line_no").collect()] == [(1500, "one"), (2000, "two")]
    assert resources.synchronized(zipped).first()["synchronized"]


def test_families(spark):
    listed = files(spark, ("a", "X.IDX", b"SSEDINFO.."), ("b", "main.data", b""), ("c", "menuData.xml", b""), ("d", "readme", b""))
    assert {r["dir"]: r["family"] for r in resources.families(listed, source.CATALOG_MAGIC).collect()} == {"a": "catalog", "b": "payload", "c": "multi_view", "d": "unknown"}


def test_sqlite(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t_contents (f_DataId INTEGER, f_Title TEXT, f_Html BLOB)")
    con.executemany("INSERT INTO t_contents VALUES (?, ?, ?)", [(1, "one", b"<b>"), (2, None, None), (3, "three", "text")])
    con.execute('CREATE TABLE "odd ""name" (x)')
    data = files(spark, ("p", "a.db", con.serialize()), ("p", "b.txt", b"no"))
    assert [(r["tbl"], r["columns"], r["row_count"]) for r in sqlite.tables(data).orderBy("tbl").collect()] == [('odd "name', ["x"], 0), ("t_contents", ["f_DataId", "f_Title", "f_Html"], 3)]
    got = sqlite.scan(data, "t_contents", "id long, title string, html binary, plain string", {"id": ["f_dataid"], "title": ["F_TITLE"], "html": ["f_html"]}).orderBy("id").collect()
    assert [(r["id"], r["title"], r["html"] and bytes(r["html"]), r["plain"]) for r in got] == [(1, "one", b"<b>", None), (2, None, None, None), (3, "three", b"text", None)]
    assert sqlite.scan(data, "missing", "id long").count() == 0


def test_imports(spark, tmp_path):
    (tmp_path / "e.csv").write_text('﻿TITLE,Html\n"a","x\ny"\nb,\n', encoding="utf-8")
    assert sorted(tuple(r) for r in sqlite.csv_entries(spark, str(tmp_path / "e.csv")).collect()) == [("a", "x\ny"), ("b", "")]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("term_bank_2.json", json.dumps([["c", 1, {"k": 2}]]))
        z.writestr("term_bank_1.json", json.dumps([["a", "b", "c"], ["short"], 5]))
    got = sqlite.zip_banks(files(spark, ("p", "z.zip", held.getvalue())), {"term_bank": 3}).orderBy("bank").collect()
    assert [(r["bank"], r["row_idx"], r["fields"]) for r in got] == [(1, 0, ["a", "b", "c"]), (2, 0, ["c", "1", '{"k": 2}'])]


def test_media(spark):
    image = b"\x1f\x4d" + bytes(12) + bytes.fromhex("000000120034")
    audio = b"\x1f\x4a" + be(1, 2) + be(1, 2) + bytes.fromhex("000000020010") + bytes.fromhex("000000020019")
    far = b"\x23\x61" * 60
    data = b"\x1f\x09\x00\x07" + image + far + audio + b"\x1f\x4d" + bytes(12) + b"\xaa" * 6
    refs = media.references(decoded(spark, data), KEYS).orderBy("start").collect()
    assert [(r["kind"], r["section_code"], r["start_block"], r["start_offset"]) for r in refs] == [("image", "0007", 12, 34), ("audio", None, 2, 10)]
    sizes = spark.createDataFrame([(2, 10, 2, 19)], "a long, b int, c long, d int").select(*[media.audio_size(F.col("a"), F.col("b"), F.col("c"), F.col("d"), x) for x in (True, False)]).first()
    assert tuple(sizes) == (10, 9)
    wrap = lambda b, extra=0: b"data" + (len(b) + extra).to_bytes(4, "little") + b
    png = b"\x89PNG\r\n\x1a\n" + bytes(4) + b"IHDR" + be(7, 4) + be(9, 4) + bytes(5)
    jpeg = b"\xff\xd8\xff\xe0" + be(4, 2) + b"ab" + b"\xff\xc0" + be(11, 2) + b"\x08" + be(5, 2) + be(6, 2) + bytes(10)
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate([wrap(png), wrap(jpeg), wrap(png), wrap(png, 9), b"none", wrap(b"")])], "k int, bytes binary")
    got = media.records(rows).orderBy("k").collect()
    assert [(r["status"], r["media_type"], r["width"], r["height"]) for r in got][:5] == [("ok", "png", 7, 9), ("ok", "jpeg", 6, 5), ("ok", "png", 7, 9), ("truncated", "unknown", None, None), ("not_a_record", "unknown", None, None)]
    assert got[5]["status"] == "empty"
    assert {(r["media_type"], r["n"], r["duplicates"]) for r in media.summary(media.records(rows)).collect()} == {("png", 2, 1), ("jpeg", 1, 0)}
    wave = b"RIFF" + (36).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\2\0" + (8000).to_bytes(4, "little") + bytes(4) + b"\2\0\x10\0"
    fmt = spark.createDataFrame([(bytearray(wave),)], "d binary").select(media.wave_format(F.col("d")).alias("f")).first()["f"]
    assert (fmt["channels"], fmt["rate"], fmt["bits"]) == (2, 8000, 16)


def test_menus(spark):
    sec = lambda c: b"\x1f\x09" + be(c, 2)
    link = lambda label, block, at: b"\x1f\x42" + sink.cells(label) + b"\x1f\x62" + be(block, 4) + be(at, 2)
    data = sec(1) + sink.cells("Top") + b"\x1f\x0a" + sec(3) + link("go", 0x12AB, 7) + b"\x1f\x0a\x1f\x0a" + sec(3) + link("null", 0, 0) + b"\x1f\x0a" + sec(1) + sink.cells("End")
    rows = menus.lines(decoded(spark, data), KEYS)
    made = menus.tree(rows, KEYS).orderBy("line_idx").collect()
    assert [(r["line_idx"], text_, r["depth"]) for r, text_ in zip(made, [r["text"] for r in made], strict=True)] == [(1, "Ｔｏｐ", 1), (2, "ｇｏ", 2), (4, "ｎｕｌｌ", 2), (5, "Ｅｎｄ", 1)]
    assert [r["path"] for r in made] == [["Ｔｏｐ"], ["Ｔｏｐ", "ｇｏ"], ["Ｔｏｐ", "ｎｕｌｌ"], ["Ｅｎｄ"]]
    assert (made[1]["links"][0]["block"], made[1]["links"][0]["offset"], made[1]["links"][0]["is_null"]) == (0x12AB, 7, False)
    assert tuple(menus.destination_counts(rows, KEYS).select("links", "null_links", "pointing").first()) == (2, 1, 1)


def test_alignment_votes(spark):
    df = spark.createDataFrame([("a<hA121>b<zB122><zB123>", "aéb漢字"), ("x<hA121>y", "xéy"), ("p<hA121>q", "pabcq"), (None, "z")], "raw string, shown string")
    assert {(r["code"], r["char"]): r["n"] for r in glyphs.votes(df, "raw", "shown").collect()} == {("a121", "é"): 2, ("b122", "漢"): 1, ("b123", "字"): 1}


def test_verification_of_a_written_tree(spark):
    entries = [(f"key {k:05d}", "body") for k in range(900)]
    listed = spark.createDataFrame([(d, n, bytearray(c)) for d, n, c in sink.build("p", "T", entries)], "dir string, name string, content binary")
    pages = source.pages(source.chunks(source.components(source.catalogs(listed), listed)).filter("ctype = 145")).cache()
    branches = verify.branch_rows(pages)
    assert branches.count() > 10
    assert verify.branch_issues(branches, pages).count() == 0
    assert verify.unreachable(branches, pages).count() == 0
    rows = streams.index_rows(streams.index_leaves(pages))
    assert rows.count() == 900 and verify.scattered_keys(rows).count() == 0
    lost = branches.withColumn("child_block", F.when(F.col("row_idx") == 1, 999_999).otherwise(F.col("child_block")))
    assert {r["code"] for r in verify.issue_counts(verify.branch_issues(lost, pages)).collect()} == {"invalid_child_block"}
    assert verify.unreachable(lost, pages).count() > 0
    starts = rows.select("package_id", (F.col("body.block") * 2048 + F.col("body.offset")).alias("place"))
    wrong = starts.limit(3).withColumn("place", F.col("place") + 1)
    assert verify.pointer_issues(starts, starts, "off").count() == 0 and verify.pointer_issues(wrong, starts, "off").count() == 3


def test_panels(spark):
    le = lambda v: v.to_bytes(4, "little")
    row = lambda block, at, label: le(block) + le(at) + sink.cells(label).ljust(8, b"\0")
    plain, fewer = le(2) + le(8) + row(5, 6, "ab") + row(7, 8, "c"), le(9) + le(8) + row(1, 2, "x") + row(1, 2, "y")
    with_id, wrong = le(1) + le(8) + le(77) + row(3, 4, "z"), le(1) + le(8) + b"?"
    got = resources.panels(files(spark, ("a", "p", plain), ("b", "p", fewer), ("c", "p", with_id), ("d", "p", wrong), ("e", "p", le(0) + le(0)))).orderBy("package_id", "idx").collect()
    assert [(r["package_id"], r["layout"], r["record_id"], r["block"], r["offset"], r["label"]) for r in got] == [
        ("a", "address_label", None, 5, 6, "ａｂ"), ("a", "address_label", None, 7, 8, "ｃ"), ("b", "address_label_fewer", None, 1, 2, "ｘ"), ("b", "address_label_fewer", None, 1, 2, "ｙ"), ("c", "id_address_label", 77, 3, 4, "ｚ")]


def test_suffix_index_with_absent_chunks(spark):
    key = sink.cells("abc")[::-1]
    page = (b"\x00\x06" + be(1, 2) + sink.cells("cba") + be(42, 4)).ljust(2048, b"\0")
    df = spark.createDataFrame([("p", "S", 0xA1, 0, 9, bytearray(page))], "package_id string, component string, ctype int, page_idx int, logical_block long, page binary")
    got = resources.suffix_keys(verify.branch_rows(df)).first()
    assert (got["key"], got["child_block"]) == ("abc", 42) and key
    data = sink.component(bytes(3 * 32768), 1, 0)
    listed = files(spark, ("p", "C.IDX", sink.catalog("t", [("S.BIN", 0, 1, 48)])), ("p", "S.BIN", data[: len(data) // 2]))
    seen = resources.chunk_presence(source.components(source.catalogs(listed), listed)).first()
    assert (seen["chunks"], seen["present"], seen["complete"]) == (3, 2, False)


def test_reports_and_assets(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1, "b": "x"}\n\n[1]\n{bad\n5\n{"a": null}\n', encoding="utf-8")
    assert sorted(map(str, (tuple(r) for r in reports.json_lines(spark, str(tmp_path / "r.jsonl"), "a long, b string").collect()))) == ["(1, 'x')", "(None, None)"]
    listed = files(spark, ("p", "Icon_dark.PNG", b""), ("p", "icon_light.png", b""), ("p", "main.css", b""), ("p", "x.bin", b""), ("p", "menu.xml", b'<m><item title="A" href="x.html"/><i href=\'#b\' label="B">t</i><n title="no"/></m>'))
    found = reports.assets(listed)
    assert {(r["stem"], r["theme"], r["kind"]) for r in found.collect()} == {("icon", "dark", "image"), ("icon", "light", "image"), ("main", None, "template")}
    assert {(r["kind"], r["n"], r["themed"]) for r in reports.asset_counts(found).collect()} == {("image", 2, 2), ("template", 1, 0)}
    assert [(r["label"], r["href"]) for r in reports.menu_items(listed).orderBy("k").collect()] == [("A", "x.html"), ("B", "#b")]


def test_unreachable_in_deep_trees_and_loops(spark):
    chain = [("p", "I", k, 1, "AA", k + 1, False) for k in range(1, 10)] + [("p", "I", 10, 1, "AA", 1, False)]
    branches = spark.createDataFrame(chain, "package_id string, component string, logical_block long, row_idx int, key_hex string, child_block long, last_sibling boolean")
    pages = spark.createDataFrame([("p", "I", k) for k in (*range(1, 11), 99)], "package_id string, component string, logical_block long")
    assert [r["logical_block"] for r in verify.unreachable(branches, pages).collect()] == [99]


def test_index_paths_of_twenty_levels(spark):
    rows = [("p", "a.idx", k + 1, f"{k:08x}\t00000001" + "\t" * (k + 1) + f"L{k}") for k in range(20)]
    got = resources.aux_index(spark.createDataFrame(rows, "package_id string, name string, line_no int, line string")).orderBy("line_no").collect()
    assert got[-1]["path"] == [f"L{k}" for k in range(20)] and got[0]["path"] == ["L0"]


def test_index_specs_and_statistics(spark):
    text = "[GENERAL]\n;c\nIDXCOUNT=2\nIDXTITLE=First\nIDXINFO0=A.TXT\nIDXNAME1: Second\nIDXINFO1=b.txt\n[OTHER]\nIDXCOUNT=9\n"
    lines = spark.createDataFrame([("p", "EXINFO.INI", k, line) for k, line in enumerate(text.split("\n"))], "package_id string, name string, line_no int, line string")
    listed = spark.createDataFrame([("p", "a.txt")], "dir string, name string")
    got = resources.aux_specs(resources.ini_values(lines, "GENERAL"), listed).orderBy("k").collect()
    assert [(r["k"], r["title"], r["info"], r["file"]) for r in got] == [(0, "First", "A.TXT", "a.txt"), (1, "Second", "b.txt", None)]
    rows = spark.createDataFrame([("p", 1, 1, 5, 0), ("p", 2, 2, 0, 0), ("p", 3, 2, 0x30000000, 0xFFFF), ("p", 4, 1, 99, 1)], "package_id string, line_no int, depth int, block long, offset int")
    comps = spark.createDataFrame([("p", 0, "BODY", 2, 9)], "package_id string, idx int, component string, start_block long, end_block long")
    found = {(r["family"], r["key"]): r["n"] for r in menus.index_statistics(rows, comps, ["package_id"]).collect()}
    assert found == {("depth", "1"): 2, ("depth", "2"): 2, ("target", "component"): 1, ("target", "null"): 1, ("target", "selector"): 1, ("target", "none"): 1, ("component", "BODY"): 1, ("pointer", "zero"): 1, ("row", "leaf"): 3}


def test_audio_headers_and_files(spark, tmp_path):
    fmt = b"fmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (2).to_bytes(2, "little") + (8000).to_bytes(4, "little") + (32000).to_bytes(4, "little") + (4).to_bytes(2, "little") + (16).to_bytes(2, "little")
    chunks = b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + fmt + b"data" + (4).to_bytes(4, "little") + b"\1\2\3\4"
    mp3 = b"\xff\xfb\x90\xc0" + bytes(40)
    rows = [(1, "a b.wav", chunks), (2, "a b.wav", mp3), (3, None, b"\x89PNG\r\n\x1a\n"), (4, "..", b"?"), (5, "x", None)]
    df = spark.createDataFrame([("p", k, n, bytearray(d) if d is not None else None) for k, n, d in rows], "package_id string, number int, name string, payload binary")
    heads = {r["number"]: r["h"] for r in df.select("number", media.audio_header(F.col("payload")).alias("h")).collect()}
    assert tuple(heads[1]) == ("wave_chunks", 2, 8000, 16, 44, 4)
    assert tuple(heads[2])[:3] == ("mp3", 1, 44100) and heads[3]["kind"] is None and heads[5]["kind"] is None
    wrapped = df.filter("number = 1").select(media.riff_wrapped(F.col("payload")).alias("w"))
    assert tuple(wrapped.select(media.wave_format(F.col("w")).alias("f")).first()["f"])[:3] == (2, 8000, 16)
    named = media.file_names(df.filter("payload is not null"), ["package_id"], "number", "name", "payload")
    assert {r["number"]: r["file_name"] for r in named.collect()} == {1: "a_b.wav", 2: "00002_a_b.wav", 3: "media_3.png", 4: "media_4.bin"}
    written = media.write_files(named, tmp_path.as_uri(), "package_id")
    assert written.count() == 4 and (tmp_path / "p" / "a_b.wav").read_bytes() == chunks


def test_referenced_ranges_across_chunks(spark):
    body = bytes(k * 7 % 251 for k in range(3 * 32768))
    chunks = spark.createDataFrame([("p", 3, k, bytearray(body[k * 32768 : (k + 1) * 32768])) for k in range(3)], "package_id string, start_block long, chunk_idx int, bytes binary")
    wanted = [(3, 0, 10), (3, 2000, 100), (18, 2000, 5000), (19, 0, 32768 + 7), (300, 0, 4)]
    refs = spark.createDataFrame([("p", *w) for w in wanted], "package_id string, start_block long, start_offset int, size long")
    got = {(r["start_block"], r["start_offset"]): r["bytes"] for r in media.referenced(refs, chunks).collect()}
    for block, offset, size in wanted:
        at = (block - 3) * 2048 + offset
        assert got[block, offset] == (bytearray(body[at : at + size]) if block < 300 else None)


def test_glyph_bitmaps(spark):
    row = spark.createDataFrame([(9, 2, bytearray(b"\x80\x00\x00\x80"))], "w int, h int, g binary").select(media.glyph_bmp(F.col("w"), F.col("h"), F.col("g")).alias("b")).first()["b"]
    assert row[:2] == b"BM" and int.from_bytes(row[2:6], "little") == len(row) and row[-8:-6] == b"\xff\x7f" and row[-4:-2] == b"\x7f\xff"


def test_targets_inside_claimed_folders_go(spark):
    found = spark.createDataFrame([("/r/X_one", "multi_view"), ("/r/X_one/sub/in", "catalog"), ("/r/X_one2", "catalog"), ("/r/two", "payload"), ("/r/two", "payload")], "dir string, family string")
    assert [(r["package_id"], r["family"]) for r in source.targets(found, "X_").collect()] == [("one", "multi_view"), ("one2", "catalog"), ("two", "payload")]
