"""Operators on small tables, and the traps of their semantics."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.functions import bytes as binary
from leafmill.functions import lookup, text
from leafmill.operators import aggregates, classify, diff, joins, ranks, render, search, streams, windows
from leafmill.plans import package_queries
from leafmill.sinks import markup, reports


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_reader_and_author_keys_differ():
    assert text.reader_key("ヴァ・ab-c") == "ゔぁABC"
    assert text.author_key("ヴァ・ab-c") == "うぁabc"
    assert text.reader_key("straße") == "STRAßE"
    assert text.reader_key(None) == "" and text.reader_key(" - ") == ""
    assert text.author_key("a.b (c)") == "abc" and text.reader_key("a.b") == "A.B"


def test_empty_normalized_term_matches_forward(spark):
    df = spark.createDataFrame([("alpha", 1), ("-", 2)], "key string, id int")
    hits = search.search(df, "key", "-", search.PHASES, ["id"], 10, text.ascii_key(F.col("key")), "")
    assert rows(hits, "profile", "id") == [("exact", 2), ("forward", 1)]
    assert search.search(df, "key", "  ", search.PHASES, ["id"], 10).count() == 0


def test_search_without_a_limit_takes_all_hits_and_sorts_none(spark):
    df = spark.range(1_000_500).selectExpr("concat('red', id) as key", "id")
    hits = search.search(df, "key", "red", ["forward"], ["id"], None)
    assert hits.count() == 1_000_500
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Sort", "Limit", "Window"))


def test_search_packages_counts_all_hits(spark, monkeypatch):
    asked = []
    real = search.search
    monkeypatch.setattr(search, "search", lambda *a, **k: asked.append(a[5]) or real(*a, **k))
    part = spark.createDataFrame([(k, "B#1", f"red plate {k}", "T", k) for k in range(3)], "p_partkey long, p_brand string, p_name string, p_type string, p_size long")
    assert rows(package_queries.search_packages(lambda name: part)) == [("B#1", 3)]
    assert asked == [None]


def test_search_phases_limit_and_identity(spark):
    df = spark.createDataFrame([("ring", 1), ("ring two", 2), ("a ring", 3), ("a ring", 2)], "key string, id int")
    assert rows(search.search(df, "key", "ring", search.PHASES, ["id"], 10), "hit_id", "profile", "id") == [(1, "exact", 1), (2, "forward", 2), (3, "backward", 3)]
    assert search.search(df, "key", "ring", search.PHASES, ["id"], 2).count() == 2


def test_first_containing_takes_the_first_range(spark):
    points = spark.createDataFrame([("g", 5), ("g", 15), ("g", 99), ("h", 5), (None, 5)], "g string, at long")
    ranges = spark.createDataFrame([("g", 0, 9, 1), ("g", 4, 30, 0)], "g string, low long, high long, idx int")
    assert rows(joins.first_containing(points, ranges, "g", "at", "low", "high", "idx", ["idx"], 8), "g", "at", "idx") == sorted([("g", 5, 0), ("g", 15, 0), ("g", 99, None), ("h", 5, None), (None, 5, None)], key=str)


def test_anchor_and_body_driven_duplicates(spark):
    anchors = spark.createDataFrame([(1, 10), (1, 20), (2, 30)], "id int, rec int")
    found = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "id int, v string")
    assert rows(joins.anchored(anchors, found, "id", "rec"), "id", "rec", "v", "found") == sorted([(1, 10, "x", True), (1, 10, "y", True), (2, 30, None, False)], key=str)
    last = joins.body_driven(found, anchors.withColumn("r", F.col("rec")), "id", "rec")
    assert rows(last, "id", "v", "r") == [(1, "x", 20), (1, "y", 20)]


def test_scaled_and_positional(spark):
    pointers = spark.createDataFrame([(5,), (10,), (7,)], "p long")
    keyed = spark.createDataFrame([(1,)], "k long")
    assert rows(joins.scaled(pointers, keyed, "p", "k", 5), "p", "status") == [(10, "missing"), (5, "resolved"), (7, "invalid_pointer")]
    left, right = spark.range(100, 107).toDF("a"), spark.range(3).toDF("b")
    assert rows(joins.positional(left, right, "a", "b"), "a", "b") == [(100, 0), (101, 1), (102, 2)]


def test_nearest_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, 1, 100), (2, 1, 500), (3, 2, 100)], "key int, g int, at long")
    right = spark.createDataFrame([(1, 96, 8), (1, 104, 7), (1, 517, 6)], "g int, there long, ord int")
    got = joins.nearest(left, right, "g", "at", "there", 16, "key", "ord", ["ord"])
    assert rows(got, "key", "ord", "distance") == [(1, 7, 4), (2, None, None), (3, None, None)]


def test_ranks_are_those_of_one_sort(spark):
    df = spark.createDataFrame([(k * 7 % 50, k) for k in range(120)], "a long, b long").repartition(6)
    got = {(r["a"], r["b"]): r["rank"] for r in ranks.with_rank(df, "a", [F.col("b")]).collect()}
    assert got == {key: k + 1 for k, key in enumerate(sorted((k * 7 % 50, k) for k in range(120)))}
    assert ranks.with_rank(df.limit(0), "a").count() == 0


def test_worst_status_order(spark):
    df = spark.createDataFrame([("a", "yes"), ("a", "n/a"), ("b", "unknown"), ("b", "partial"), ("c", "no"), ("c", "yes")], "k string, s string")
    assert rows(aggregates.worst(df, "k", "s", aggregates.CAPABILITY)) == [("a", "n/a"), ("b", "unknown"), ("c", "no")]
    colours = spark.createDataFrame([("gray", "yellow"), ("green", "gray")], "a string, b string")
    assert [r[0] for r in colours.select(classify.worse(F.col("a"), F.col("b"))).collect()] == ["yellow", "gray"]


def test_mode_and_median_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 5, 3, 3, 9)] + [("b", 4), ("b", 8)], "k string, v long")
    assert rows(aggregates.mode(df, "k", "v")) == [("a", 3, 2), ("b", 4, 1)]
    assert rows(aggregates.upper_median(df, "k", "v")) == [("a", 5, 5), ("b", 8, 2)]


def test_intervals_are_inclusive_and_adjoin(spark):
    df = spark.createDataFrame([("c", 0, 4), ("c", 5, 6), ("c", 8, 9), ("c", 2, 3)], "k string, a long, b long")
    merged = windows.islands(df, "k", "a", "b")
    assert rows(merged, "island_start", "island_end") == [(0, 6), (8, 9)]
    assert rows(windows.gaps(merged, "k", F.lit(0).cast("long"), F.lit(12).cast("long")), "gap_start", "gap_end") == [(10, 12), (7, 7)]


def test_clipped_depth_and_paths(spark):
    steps = [-1, 1, 1, -1, -1, -1, 1]
    df = spark.createDataFrame([("k", n, s) for n, s in enumerate(steps)], "k string, n int, s int")
    assert [r["depth"] for r in windows.clipped_depth(df, "k", ["n"], F.col("s")).orderBy("n").collect()] == [0, 1, 2, 1, 0, 0, 1]
    tree = spark.createDataFrame([("k", n, d, label) for n, (d, label) in enumerate([(1, "a"), (2, "b"), (3, "c"), (2, "d"), (1, "e"), (3, "f")])], "k string, n int, d int, l string")
    assert [r["path"] for r in windows.paths(tree, "k", "n", "d", "l", 3).orderBy("n").collect()] == [["a"], ["a", "b"], ["a", "b", "c"], ["a", "d"], ["e"], ["e", "f"]]


def test_diff_null_is_not_absent_and_empty_is_invisible(spark):
    old = spark.createDataFrame([("r", '{"a": null, "b": [1, 2], "c": {}}')], "id string, body string")
    new = spark.createDataFrame([("r", '{"b": [0, 1, 2], "d": []}')], "id string, body string")
    got = diff.changes(diff.flat_paths(old, "body", ["id"]), diff.flat_paths(new, "body", ["id"]), ["id", "path"], "value")
    assert rows(got, "path", "change", "old_value", "new_value") == sorted([("a", "removed", "null", None), ("b[0]", "changed", "1", "0"), ("b[1]", "changed", "2", "1"), ("b[2]", "added", None, "2")], key=str)
    assert diff.flat_paths(spark.createDataFrame([("r", "{bad"), ("r", None)], "id string, body string"), "body", ["id"]).count() == 0


def test_glyph_buckets(spark):
    cases = [
        ("a126", 3, "x", None, False, None, False, False, "unicode_mapped"), ("b13d", 4, None, None, True, None, False, False, "image_backed"),
        ("a430", 6, None, None, False, True, True, False, "formatting_helper"), ("b200", 5, None, None, False, None, False, False, "formatting_helper"),
        ("a1aa", 1, None, None, False, None, False, False, "display_unresolved"), ("a1ab", 2, None, None, False, None, False, True, "renderer_entry_backed"),
        ("a1bb", 0, "y", None, False, None, False, False, "unused_mapping"),
    ]
    df = spark.createDataFrame([c[:8] for c in cases], "code string, n int, display string, fallback string, image boolean, blank boolean, bitmap boolean, entry boolean")
    c = F.col
    made = df.withColumn("bucket", classify.glyph_bucket(c("n"), c("display"), c("image"), c("blank"), c("bitmap"), c("entry"), c("code")))
    assert {r["code"]: r["bucket"] for r in made.collect()} == {x[0]: x[8] for x in cases}
    row = classify.glyph_summary(made.withColumn("p", F.lit("p")), "p").first()
    assert (row["status"], row["unresolved"], row["helper"]) == ("partial", 1, 11)


def test_dense_is_strict(spark):
    df = spark.createDataFrame([(64, 1, 0), (63, 1, 0), (0, 0, 0), (100, 0, 2)], "size long, m long, t long")
    assert [r[0] for r in df.select(classify.body_shape(F.col("size"), F.col("m"), F.col("t"))).collect()] == ["sliced", "dense", "empty", "index_only"]


def test_bytes(spark):
    data = bytearray.fromhex("000000120034") + bytearray.fromhex("0000ab120034")
    df = spark.createDataFrame([(data,)], "d binary")
    one = df.select(binary.pointer(F.col("d")).alias("a"), binary.pointer(F.col("d"), 6).alias("b"), binary.le(F.col("d"), 3, 2).alias("le"), binary.be(F.col("d"), 11, 2).alias("beyond")).first()
    assert tuple(one["a"]) == (12, 34, "decimal") and tuple(one["b"]) == (0xAB12, 0x34, "binary")
    assert one["le"] == 0x0012 and one["beyond"] is None
    virtual = spark.createDataFrame([(0x30000000, 0xFFFF), (0x30000001, 0xFFFF), (0x30000000, 1)], "b long, o int")
    assert [r[0] for r in virtual.select(binary.virtual_selector(F.col("b"), F.col("o"))).collect()] == [3, None, None]
    magic = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n.."),), (bytearray(b"BM.."),), (bytearray(b"??"),)], "d binary")
    assert [r[0] for r in magic.select(binary.content_kind(F.col("d"))["kind"]).collect()] == ["png", "bmp", "unknown"]


@pytest.mark.parametrize("stamp, ms", [("1:02:03.5", 3_723_500), ("02:03,25", 123_250), ("777", 777), ("x", None), ("1:2:3:4", None), ("", None)])
def test_milliseconds(spark, stamp, ms):
    assert spark.createDataFrame([(stamp,)], "s string").select(text.milliseconds(F.col("s"))).first()[0] == ms


def test_text_functions(spark):
    df = spark.createDataFrame([("<p>a<br/>b &amp; c</p>\n\n\n\n<i>d</i>", "http://x/y", "Ａ　－b", " a, b;a ")], "h string, u string, w string, v string")
    one = df.select(text.plain_text(F.col("h")), text.safe_url(F.col("u")), text.narrowed(F.col("w")), text.split_values(F.col("v")), text.redacted(F.lit("/r/a/b"), "/r", "pkg")).first()
    assert tuple(one) == ("a\nb & c\n\nd", True, "A -b", ["a", "b"], "<pkg>/a/b")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, "x|y\n z", {"k": 1}, None)], "b int, a string, m map<string,int>, n string")
    assert reports.canonical_json(df, ["b", "a", "n"]).first()[0] == '{"a":"x|y\\n z","b":2,"n":null}'
    assert reports.tab_lines(df, ["a", "m"]).first()[0] == 'x|y z\t{"k":1}'
    assert reports.markdown_rows(df, ["b", "a"]).first()[0].startswith("| 2 | x\\|y")
    reports.write_jsonl(df.select("b", "a"), str(tmp_path / "o"), "b")
    assert spark.read.json(str(tmp_path / "o")).count() == 1


def test_pattern_counts_prefer_longer_words(spark):
    df = spark.createDataFrame([("then the",), (None,)], "t string")
    assert rows(joins.pattern_counts(df, "t", ["the", "then"])) == [("the", 1), ("then", 1)]


def test_entropy_and_samples(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 4, "v": [1, 1, 2, 2], "o": [3, 1, 2, 0]}))
    assert aggregates.entropy(df, "k", "v").first()["entropy"] == pytest.approx(1.0)
    assert rows(aggregates.samples(df, "k", ["o"], 2), "o", "place") == [(0, 1), (1, 2)]


def test_many_ties_spread_and_rank(spark):
    df = spark.createDataFrame([(1, k) for k in range(300)] + [(0, 7)], "a long, b long").repartition(5)
    got = {(r["a"], r["b"]): r["rank"] for r in ranks.with_rank(df, "a", [F.col("b")]).collect()}
    assert got == {(0, 7): 1} | {(1, k): k + 2 for k in range(300)}


def test_terms_of_any_length(spark):
    data = spark.createDataFrame([(k, n) for k, n in enumerate(["a", "ab", "abc", "abcd", "b", "bcde", ""])], "id int, name string")
    terms = spark.createDataFrame([("",), ("a",), ("ab",), ("abc",), ("abcd",), ("z",), (None,)], "t string")
    got = {(r["term"], r["id"]) for r in search.search_many(data, "name", terms, "t", ["id"], 3, 3).collect()}
    names = {k: n for k, n in enumerate(["a", "ab", "abc", "abcd", "b", "bcde", ""])}
    want = {(t, k) for t in ("", "a", "ab", "abc", "abcd", "z") for k in sorted((k for k, n in names.items() if n.startswith(t)), key=lambda k: (names[k], k))[:3]}
    assert got == want


def test_key_candidates():
    cell = lambda s: s.encode("iso2022_jp")[3:-3]
    assert lookup.key_candidates("a-b") == [b"a-b", cell("ａ−ｂ"), b"AB", cell("ＡＢ")]  # the full-width hyphen has no cell of its own
    assert lookup.key_candidates("ab", backward=True)[0] == b"ba"
    assert cell("きやつと") in lookup.key_candidates("きゃっと")
    assert lookup.key_candidates(" ") == []


def test_predicates(spark):
    cases = [("", True), ("<section:0001> <media:00ff>", True), ("0123abcd", True), ("0123ab\n4567cd", True), ("QUJDREVG==", True), ("word of text", False), (None, True), ("abc", False), ("<section:0001>x y", False)]
    df = spark.createDataFrame([c[:1] for c in cases], "b string")
    assert [r[0] for r in df.select(lookup.useless_body(F.col("b"))).collect()] == [c[1] for c in cases]
    shown = [("é", True), ("a", False), ("ab", True), ("a b", False), ("", False), (None, False), ("漢", True), ("\u3000", False), ("\x01", False)]
    df = spark.createDataFrame([s[:1] for s in shown], "d string")
    assert [r[0] for r in df.select(lookup.informative_display(F.col("d"))).collect()] == [s[1] for s in shown]
    missing = [("é", "", 1, True), ("é", "e", 1, False), ("漢", None, 1, False), ("é", "", 0, False), ("♪", None, 2, True), ("𠀋", None, 1, True), ("a\u0301", None, 1, True), (None, None, 1, False)]
    df = spark.createDataFrame([m[:3] for m in missing], "d string, f string, n int")
    assert [r[0] for r in df.select(lookup.search_fallback_missing(F.col("d"), F.col("f"), F.col("n"))).collect()] == [m[3] for m in missing]
    columns = [("x", "varchar(9)", True), ("f_HTML", "BLOB", True), ("x", "INTEGER", False), ("title", None, True)]
    df = spark.createDataFrame([c[:2] for c in columns], "n string, t string")
    assert [r[0] for r in df.select(lookup.text_column(F.col("n"), F.col("t"))).collect()] == [c[2] for c in columns]
    names = spark.createDataFrame([("X_ab",), ("AB",), ("cd",)], "n string")
    assert [r[0] for r in lookup.selected(names, "n", ["x_AB"], "X_").collect()] == ["X_ab", "AB"] and lookup.selected(names, "n", []).count() == 3
    texts = spark.createDataFrame([("10",), ("9",), ("x",), ("2b",)], "t string")
    assert [r[0] for r in texts.orderBy(*lookup.by_number(["t"])).collect()] == ["x", "2b", "9", "10"]


def test_markup_becomes_body_bytes_and_text(spark):
    rows = [("<p>One <b>two</b></p><ul><li>a<li>b &amp; c</ul>", "One two\n・a\n・b & c"), ("x<br/><br/>y<img alt='pic'>", "x\ny［pic］"), ("<i>open", "open"), ("", "")]
    df = spark.createDataFrame([("p", "B", k, h) for k, (h, _) in enumerate(rows)], "package_id string, component string, entry_idx int, h string")
    keys = ["package_id", "component", "entry_idx"]
    made = df.withColumn("bytes", markup.html_body(F.col("h"))).drop("h")
    decoded = streams.spans(made, keys)
    assert decoded.filter("issue is not null").count() == 0
    got = {r["entry_idx"]: r["text"] for r in streams.entry_text(decoded, keys).collect()}
    assert {k: got.get(k, "") for k in range(4)} == {k: narrow for k, (_, narrow) in enumerate(rows)}
    tree = '{"type": "structured-content", "content": [{"tag": "div", "content": ["a", {"tag": "b", "content": "b"}]}, {"type": "image", "path": "p.png"}, 5]}'
    body = spark.createDataFrame([("p", "B", 0, tree)], "package_id string, component string, entry_idx int, h string").withColumn("bytes", markup.structured_body(F.col("h"))).drop("h")
    assert streams.entry_text(streams.spans(body, keys), keys).first()["text"] == "ab\n［p.png］5"
    values = [('{"displayValue": null, "value": ["a", {"x": 1, "b": 2}]}', 'a, {"b":2,"x":1}'), ('"x  y"', "x y"), ("null", ""), ("not json", "not json"), ("true", "True"), ("3", "3")]
    got = spark.createDataFrame([v[:1] for v in values], "v string").select(markup.scalar_text(F.col("v"))).collect()
    assert [r[0] for r in got] == [v[1] for v in values]


def test_rendering_profiles_and_policies(spark):
    keys = ["package_id", "component", "entry_idx"]
    data = b"\x1f\x41\x00\x00\x1f\x04\x23\x68\x1f\x05\x1f\x61\x1f\x0a\x1f\x04\x23\x61\x1f\x05\x1f\x10\xa1\x21\x1f\x11\xb1\x21\x1f\x0a\x1f\x0a\x1f\x99"
    df = spark.createDataFrame([("p", "B", 1, bytearray(data))], "package_id string, component string, entry_idx int, bytes binary")
    shown = spark.createDataFrame([("p", "a121", "é")], "package_id string, code string, display string")
    decoded = streams.spans(df, keys, glyphs=shown)
    known = spark.createDataFrame([("p", "b121", "formatting_helper")], "package_id string, code string, status string")
    html = lambda *a: render.html(decoded, keys, *a, glyphs=known).first()["html"]
    assert html("friendly") == '<article class="entry profile-friendly" data-render-profile="friendly"><h3 class="heading">h</h3><p class="paragraph">a<i><span class="glyph">é</span></i><span class="glyph helper" aria-hidden="true"></span></p></article>'
    assert '<span class="inline text">a</span><i class="inline inline-italic"><span class="inline glyph" data-kind="glyph">é</span></i>' in html("semantic")
    assert '<p class="reader-line">a<i class="reader-italic"><span class="reader-glyph">é</span></i>' in html("reader")
    assert 'data-code="a121" data-resource-id="glyph-a121" data-status="">&lt;hA121&gt;</span>' in html("debug")
    assert '<span class="glyph resource" data-resource-id="glyph-a121">é</span>' in html("friendly", "bitmap_preferred") and '"glyph-a121">□</span>' in html("friendly", "bitmap_only")
    text = lambda p: render.text(decoded, keys, p, glyphs=known).first()["text"]
    assert [text(p) for p in render.POLICIES] == ["h\naé", "h\naé", "h\na□", "h\na□", "h\na<hA121><hB121>"]
    modes = spark.createDataFrame([("a121", None), ("b121", None), ("b122", "x")], "c string, r string")
    assert [[r[0] for r in modes.select(render.glyph_by_mode(F.col("c"), F.col("r"), m)).collect()] for m in ("drop", "h-placeholder", "placeholder")] == [["", "", "x"], ["<hA121>", "", "x"], ["<hA121>", "<zB121>", "x"]]
