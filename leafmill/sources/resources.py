"""Resources beside a package's streams: glyph maps, bitmaps, tables, anchors, selectors, auxiliary indexes, loose files.

All take (dir, name, content) rows, as `packages.files` makes them, and cut records with
sequence and substring, so a resource is a table whatever its size; only character sets
and property lists need Python.
"""

from __future__ import annotations

import plistlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.bytes import BLOCK, be, grid_code, le
from leafmill.functions.text import narrowed, unescaped
from leafmill.operators.streams import decoded_keys, glyph_text, spans
from leafmill.operators.windows import paths
from leafmill.sources.packages import BODY_TYPE, CHUNK

# Fixed values of the formats.
MAP_MAGIC, MAP_RECORD, MAP_SIMPLE = b"Ver2  ", 16, 12
BITMAP_DATA = 2048
STRING_MAGICS, STRING_RECORD, STRING_FIRST = [b"SDICALTH", b"SDICALTF"], 62, 16
ANCHOR = 32
DIGIT_CELL, BLANK_CELL = "23(3[0-9])", "2121"
SELECTOR_HEAD, SELECTOR_RECORD, SELECTOR_REF = 0x10, 0x20, 0x10


def _records(first: Column | int, count: Column, size: int) -> Column:
    """array<struct(k, at)>: 0-based numbers of records and their places."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: F.struct(k.alias("k"), (first + k * size).alias("at"))))


def _units(data: Column, at: Column, n: int) -> Column:
    """n UTF-16 units from `at` as text, without NUL and lone surrogates."""
    hexed = F.hex(F.substr(data, (at + 1).cast("int"), F.lit(2 * n)))
    pairs = F.regexp_extract_all(hexed, F.lit("(D[89AB]..D[C-F]..|....)"), 1)
    kept = F.filter(pairs, lambda u: (u != "0000") & ~((F.length(u) == 4) & u.rlike("^D[89A-F]")))
    return F.decode(F.unhex(F.array_join(kept, "")), "UTF-16BE")


def glyph_map(files: DataFrame) -> DataFrame:
    """(package_id, section, record_idx, code, display, fallback, legacy) of map files in their three layouts.

    A magic means 16-byte records; else 12-byte records, in one section if that is exactly
    the file, in two if both fit, and anything else is no map.
    """
    data = F.col("content")
    versioned = F.startswith(data, F.lit(MAP_MAGIC))
    size = F.when(versioned, MAP_RECORD).otherwise(MAP_SIMPLE)
    half = F.when(versioned, be(data, 6, 4)).otherwise(be(data, 0, 4))
    first = F.when(versioned, 10).otherwise(4)
    rows = files.select(F.col("dir").alias("package_id"), "content", versioned.alias("versioned"), size.alias("size"), half.alias("half"), first.alias("first"), F.octet_length(data).alias("n"))
    rows = rows.withColumn("second", F.col("first") + F.col("half") * F.col("size")).filter("half is not null")
    rows = rows.withColumn("full", F.when(F.col("second") + 4 <= F.col("n"), be(data, F.col("second").cast("int"), 4)).otherwise(0))
    rows = rows.filter("versioned or second = n or (second + 4 <= n and second + 4 + full * size <= n)")
    section = lambda name, at, count: F.struct(F.lit(name).alias("section"), at.cast("long").alias("at"), count.cast("long").alias("count"))
    cut = rows.withColumn("s", F.explode(F.array(section("half", F.col("first"), F.col("half")), section("full", F.col("second") + 4, F.col("full")))))
    # A count beyond the file is cut to what is there.
    count = F.least(F.col("s.count"), F.floor((F.col("n") - F.col("s.at")) / F.col("size")))
    made = cut.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).filter(count > 0)
    at = F.col("s.at") + F.col("k") * F.col("size")
    code = F.lower(F.hex(F.substr(data, (at + 1).cast("int"), F.lit(2))))
    return made.select(
        "package_id", "s.section", (F.col("k") + F.when(F.col("s.section") == "full", F.col("half")).otherwise(0)).alias("record_idx"), code.alias("code"),
        _units(data, at + 4, 2).alias("display"), _units(data, at + 8, 2).alias("fallback"), F.when(F.col("versioned"), _units(data, at + 12, 2)).otherwise("").alias("legacy"),
    )


def glyph_displays(mapped: DataFrame) -> DataFrame:
    """(package_id, code, display): the last record of a code that has a display."""
    return mapped.filter("display <> ''").groupBy("package_id", "code").agg(F.max_by("display", "record_idx").alias("display"))


def plist_map(files: DataFrame) -> DataFrame:
    """(package_id, code, display) of property lists: four hexadecimal digits to text; of a code's files the first by name counts."""

    def entries(contents: pd.Series) -> pd.Series:
        def one(data: bytes) -> list[dict]:
            try:
                got = plistlib.loads(data)
            except Exception:  # noqa: BLE001  any broken list is no map
                return []
            return [{"code": k.lower(), "display": v} for k, v in got.items() if isinstance(k, str) and isinstance(v, str)] if isinstance(got, dict) else []

        return contents.map(one)

    rows = files.select("dir", "name", F.explode(F.pandas_udf(entries, "array<struct<code:string,display:string>>")("content")).alias("e")).filter(F.col("e.code").rlike("^[0-9a-f]{4}$"))
    return rows.groupBy(F.col("dir").alias("package_id"), F.col("e.code").alias("code")).agg(F.min_by("e.display", "name").alias("display"))


def bitmaps(files: DataFrame) -> DataFrame:
    """(package_id, resource, width, height, glyph_idx, code, blank, glyph): glyphs at their stride, codes by rows of the grid."""
    data = F.col("content")
    rows = files.select(F.col("dir").alias("package_id"), F.col("name").alias("resource"), "content", be(data, 8, 1).alias("width"), be(data, 9, 1).alias("height"), be(data, 10, 2).alias("start"), be(data, 12, 2).alias("count"))
    stride = (F.floor((F.col("width") + 7) / 8) * F.col("height")).cast("long")
    cut = rows.filter("width > 0 and height > 0 and count > 0").withColumn("stride", stride).withColumn("glyph_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    at = F.lit(BITMAP_DATA) + F.col("glyph_idx") * F.col("stride")
    glyph = F.substr(data, (at + 1).cast("int"), F.col("stride").cast("int"))
    made = cut.filter(at + F.col("stride") <= F.octet_length(data))
    code = F.lower(F.lpad(F.hex(grid_code(F.col("start"), F.col("glyph_idx"))), 4, "0"))
    return made.select("package_id", "resource", "width", "height", "glyph_idx", code.alias("code"), F.hex(glyph).rlike("^0*$").alias("blank"), glyph.alias("glyph"))


def chosen_bitmap(glyphs: DataFrame) -> DataFrame:
    """One bitmap a code: one that isn't blank first, then the earliest resource and place."""
    order = F.struct(F.col("blank").alias("b"), F.col("resource").alias("r"), F.col("glyph_idx").alias("g"))
    return glyphs.groupBy("package_id", "code").agg(F.min_by(F.struct("resource", "width", "height", "glyph_idx", "blank", "glyph"), order).alias("g")).select("package_id", "code", "g.*")


def alternate_strings(files: DataFrame) -> DataFrame:
    """(package_id, record_idx, code, value, status): fixed records whose codes must follow the grid; a break makes its rows 'bad_sequence'."""
    data = F.col("content")
    known = F.startswith(data, F.lit(STRING_MAGICS[0])) | F.startswith(data, F.lit(STRING_MAGICS[1]))
    rows = files.filter(known).select(F.col("dir").alias("package_id"), "content", be(data, 10, 2).alias("start"), be(data, 12, 2).alias("count"))
    whole = F.octet_length("content") == STRING_FIRST + F.col("count") * STRING_RECORD
    cut = rows.filter("count > 0").withColumn("whole", whole).withColumn("r", F.explode(_records(STRING_FIRST, F.col("count"), STRING_RECORD)))
    at = F.col("r.at").cast("int")
    code = be(data, at, 2)

    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: bytes(b).split(b"\0", 1)[0].decode("cp932", "replace") if b is not None else None)

    value = F.pandas_udf(decoded, "string")(F.substr(data, at + 3, F.lit(STRING_RECORD - 2)))
    status = F.when(~F.col("whole"), "bad_size").when(code != grid_code(F.col("start"), F.col("r.k")), "bad_sequence").otherwise("ok")
    return cut.select("package_id", F.col("r.k").alias("record_idx"), code.alias("code"), value.alias("value"), status.alias("status"))


def dense_anchors(expanded: DataFrame) -> DataFrame:
    """(package_id, component, record_idx, data_id, block, offset, marker_block, marker_offset) of body streams at a stride of ANCHOR bytes.

    An anchor is an entry mark at +0 or +2, a head, a half-width start, eight cells of
    digits or blanks and the half-width end; the record's own place and its mark's are both given.
    """
    own = expanded.filter(F.col("ctype") == BODY_TYPE).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("bytes") / ANCHOR).cast("int") - 1))).filter(F.octet_length("bytes") >= ANCHOR)
    row = F.hex(F.substr("bytes", F.col("k") * ANCHOR + 1, F.lit(ANCHOR)))
    shape = f"1F0900011F41....1F04((?:{DIGIT_CELL}|{BLANK_CELL}){{8}})1F05"
    cells = F.regexp_extract(row, f"^(?:....)?{shape}", 1)
    digits = F.regexp_replace(F.regexp_replace(cells, "2121", ""), "233(.)", "$1")
    found = own.select("package_id", "component", "start_block", (F.col("chunk_idx").cast("long") * (CHUNK // ANCHOR) + F.col("k")).alias("record_idx"), digits.alias("digits"), F.when(row.rlike(f"^{shape}"), 0).otherwise(2).alias("shift"))
    at = F.col("record_idx") * ANCHOR
    mark = at + F.col("shift")
    place = lambda p: (F.col("start_block") + F.floor(p / BLOCK)).cast("long")
    return found.filter("digits <> ''").select("package_id", "component", "record_idx", F.col("digits").cast("long").alias("data_id"), place(at).alias("block"), (at % BLOCK).cast("int").alias("offset"), place(mark).alias("marker_block"), (mark % BLOCK).cast("int").alias("marker_offset"))


def selectors(files: DataFrame) -> DataFrame:
    """(package_id, name, idx, subtype, label, ref_idx, ctype, start_block, block_count): records of selector descriptors with their references.

    A record is as long as its number of references says; each number has an alternative.
    """
    sizes = "|".join(f"\\x{n:02x}.{{{SELECTOR_RECORD - 1 + SELECTOR_REF * n}}}" for n in range(256))
    body = F.decode(F.substr("content", F.lit(SELECTOR_HEAD + 1), F.octet_length("content")), "ISO-8859-1")
    rows = files.select(F.col("dir").alias("package_id"), "name", be(F.col("content"), 0, 2).alias("count"), F.posexplode(F.regexp_extract_all(body, F.lit(f"(?s)\\G(?:{sizes})"), 0)).alias("k", "record")).filter("k < count")
    raw = F.encode("record", "ISO-8859-1")
    rows = rows.select("package_id", "name", (F.col("k") + 1).alias("idx"), raw.alias("raw"), F.substr(raw, F.lit(3), F.lit(SELECTOR_RECORD - 2)).alias("bytes"))
    keys = ["package_id", "name", "idx"]
    named = spans(rows.select(*keys, F.expr("unhex(regexp_extract(hex(bytes), '^((?:(?!00)..)*)', 1))").alias("bytes")), keys).filter(F.col("kind").isin("text", "ascii", "glyph"))
    shown = F.when(F.col("kind") == "glyph", glyph_text(F.col("code"), F.col("resolved"))).otherwise(F.col("normalized"))
    labels = named.groupBy(*keys).agg(narrowed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", shown.alias("s")))), lambda p: p["s"]), "")).alias("label"))
    n = be(F.col("raw"), 0, 1)
    refs = rows.withColumn("ref_idx", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))))
    at = (SELECTOR_RECORD + F.col("ref_idx") * SELECTOR_REF).cast("int")
    made = refs.select(*keys, be(F.col("raw"), 1, 1).cast("int").alias("subtype"), "ref_idx", be(F.col("raw"), at, 1).cast("int").alias("ctype"), be(F.col("raw"), at + 2, 4).alias("start_block"), be(F.col("raw"), at + 6, 4).alias("block_count"))
    return made.join(labels, keys, "left").withColumn("label", F.coalesce("label", F.lit("")))


def ini_values(lines: DataFrame, section: str) -> DataFrame:
    """(package_id, name, key, value) of a section's lines `key=value` or `key:value`; comments go, a repeated key keeps its last value."""
    order = Window.partitionBy("package_id", "name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("line", F.trim("line")).withColumn("section", F.last(F.nullif(F.regexp_extract("line", r"^\[([^\]]*)\]", 1), F.lit("")), ignorenulls=True).over(order))
    own = rows.filter((F.col("section") == section) & ~F.col("line").rlike(r"^([#;\[]|$)") & F.col("line").rlike("[=:]"))
    key, value = F.trim(F.regexp_extract("line", r"^([^=:]*)[=:]", 1)), F.trim(F.regexp_extract("line", r"^[^=:]*[=:](.*)$", 1))
    return own.groupBy("package_id", "name", key.alias("key")).agg(F.max_by(value, "line_no").alias("value"))


def aux_specs(values: DataFrame, listed: DataFrame) -> DataFrame:
    """(package_id, k, title, info, file) of the auxiliary indexes that IDXCOUNT, IDXNAMEn and IDXINFOn name; file is found without regard to case.

    The first takes IDXTITLE where it has no name; without a count IDXINFO alone makes one.
    """
    per = values.groupBy("package_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("v"))
    of = lambda name: F.coalesce(F.try_element_at("v", name if not isinstance(name, str) else F.lit(name)), F.lit(""))
    n = F.coalesce(F.trim(of("IDXCOUNT")).try_cast("int"), F.lit(0))
    single = (n <= 0) & (of("IDXINFO") != "")
    rows = per.withColumn("k", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(single, F.array(F.lit(0))).otherwise(F.expr("cast(array() as array<int>)"))))
    numbered = lambda name: of(F.concat(F.lit(name), F.col("k").cast("string")))
    title = F.when((F.col("k") == 0) & (numbered("IDXNAME") == ""), of("IDXTITLE")).otherwise(numbered("IDXNAME"))
    made = rows.select("package_id", "k", title.alias("title"), F.when(single, of("IDXINFO")).otherwise(numbered("IDXINFO")).alias("info"))
    there = listed.groupBy(F.col("dir").alias("package_id"), F.lower("name").alias("folded")).agg(F.min("name").alias("file"))
    return made.withColumn("folded", F.lower("info")).join(there, ["package_id", "folded"], "left").drop("folded")


def aux_index(lines: DataFrame) -> DataFrame:
    """(package_id, name, line_no, block, offset, depth, label, path) of lines `hex8 TAB hex8 TAB ... label`; the depth is the label's tab."""
    parts = F.split("line", "\t")
    labels = F.filter(F.transform(F.slice(parts, F.lit(3), F.size(parts)), lambda x, k: F.struct((k + 1).alias("depth"), x.alias("label"))), lambda e: e["label"] != "")
    rows = lines.filter(F.col("line").rlike("^[0-9A-Fa-f]{8}\t[0-9A-Fa-f]{8}\t.*[^\t\r\n]")).withColumn("last", F.element_at(labels, -1)).filter("last is not null")
    number = lambda k: F.conv(F.element_at(parts, k), 16, 10).cast("long")
    made = rows.select("package_id", "name", "line_no", number(1).alias("block"), number(2).alias("offset"), F.col("last.depth").alias("depth"), unescaped(F.col("last.label")).alias("label"))
    return paths(made, ["package_id", "name"], "line_no", "depth", "label")


def text_lines(files: DataFrame, charset: str = "utf-8") -> DataFrame:
    """(package_id, name, line_no, line) of text files."""

    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: bytes(b).decode(charset, "replace").removeprefix("﻿").replace("\r\n", "\n") if b is not None else None)

    text = F.pandas_udf(decoded, "string")("content")
    rows = files.select(F.col("dir").alias("package_id"), "name", F.posexplode(F.split(text, "\n")).alias("k", "line"))
    return rows.select("package_id", "name", (F.col("k") + 1).alias("line_no"), "line")


def five_line_records(lines: DataFrame) -> DataFrame:
    """(package_id, name, record, id, title, description, address, image, status): non-blank lines in groups of five; a short group is 'truncated'."""
    kept = lines.filter(F.trim("line") != "").withColumn("n", F.row_number().over(Window.partitionBy("package_id", "name").orderBy("line_no")) - 1)
    grouped = kept.groupBy("package_id", "name", F.floor(F.col("n") / 5).cast("int").alias("record")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("line").alias("l")))), lambda x: x["l"]).alias("f"))
    fields = [F.get("f", F.lit(k)).alias(c) for k, c in enumerate(["id", "title", "description", "address", "image"])]
    return grouped.select("package_id", "name", "record", *fields, F.when(F.size("f") == 5, "ok").otherwise("truncated").alias("status"))


def parallel_lines(times: DataFrame, texts: DataFrame, milliseconds) -> DataFrame:
    """(package_id, line_no, ms, line): lines of a time file with those of a text file, in full, so that a longer side shows."""
    a = times.select("package_id", "line_no", milliseconds(F.col("line")).alias("ms"), F.lit(True).alias("has_time"))
    return a.join(texts.select("package_id", "line_no", "line"), ["package_id", "line_no"], "full_outer")


def synchronized(zipped: DataFrame) -> DataFrame:
    """(package_id, synchronized): whether every line has both sides."""
    return zipped.groupBy("package_id").agg(F.bool_and(F.col("has_time").isNotNull() & F.col("line").isNotNull()).alias("synchronized"))


def families(listed: DataFrame, catalog_magic: bytes) -> DataFrame:
    """(dir, family): by what a folder holds, in order: a catalog, an SQL payload, viewer files; else unknown."""
    name = F.lower("name")
    seen = listed.groupBy("dir").agg(
        F.bool_or(F.startswith("content", F.lit(catalog_magic))).alias("catalog"), F.bool_or((name == "main.data") | name.endswith(".dbc")).alias("payload"),
        F.bool_or(name.isin("menudata.xml", "config.xml", "vertical.xml")).alias("viewer"),
    )
    return seen.select("dir", F.when(F.col("catalog"), "catalog").when(F.col("payload"), "payload").when(F.col("viewer"), "multi_view").otherwise("unknown").alias("family"))


def panels(files: DataFrame) -> DataFrame:
    """(package_id, name, layout, idx, record_id, block, offset, text_bytes, label): fixed records behind an 8-byte header.

    Layouts are tried in order by the size that they imply: records as counted, one fewer,
    or fewer still, each without and with an id before the address. Other files give no rows.
    """
    data = F.col("content")
    rows = files.select(F.col("dir").alias("package_id"), "name", "content", le(data, 0, 4).alias("count"), le(data, 4, 4).alias("width"), (F.octet_length(data) - 8).cast("long").alias("rest"))
    layouts = F.lit(None).cast("struct<layout:string,lead:int,n:bigint>")
    n = F.col("count")
    for name, lead, many in reversed([
        ("address_label", 8, n), ("id_address_label", 12, n), ("address_label_one_fewer", 8, n - 1), ("id_address_label_one_fewer", 12, n - 1),
        ("address_label_fewer", 8, None), ("id_address_label_fewer", 12, None),
    ]):
        stride = F.col("width") + lead
        if many is None:
            fits, many = (F.col("rest") % stride == 0) & (F.floor(F.col("rest") / stride) <= n) & (F.col("width") > 0), F.floor(F.col("rest") / stride)
        else:
            fits = (F.col("rest") == many * stride) & (many >= 0)
        layouts = F.when(fits, F.struct(F.lit(name).alias("layout"), F.lit(lead).alias("lead"), many.cast("bigint").alias("n"))).otherwise(layouts)
    cut = rows.withColumn("l", layouts).filter("l.n > 0").select("*", "l.*").withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = (8 + F.col("idx") * (F.col("lead") + F.col("width"))).cast("int")
    record = F.substr(data, at + 1, (F.col("lead") + F.col("width")).cast("int"))
    cut = cut.withColumn("rec", record).withColumn("with_id", F.col("lead") == 12)
    number = lambda k: F.when(F.col("with_id"), le(F.col("rec"), k + 4, 4)).otherwise(le(F.col("rec"), k, 4))
    text = F.substr("rec", F.col("lead") + 1, F.col("width").cast("int"))
    made = cut.select("package_id", "name", "layout", F.col("idx").cast("int").alias("idx"), F.when(F.col("with_id"), le(F.col("rec"), 0, 4)).alias("record_id"), number(0).alias("block"), number(4).alias("offset"), text.alias("text_bytes"))
    keys = ["package_id", "name", "idx"]
    shown = spans(made.select(*keys, F.col("text_bytes").alias("bytes")), keys).filter(F.col("kind").isin("text", "ascii", "glyph"))
    value = F.when(F.col("kind") == "glyph", glyph_text(F.col("code"), F.col("resolved"))).otherwise(F.col("normalized"))
    labels = shown.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", value.alias("s")))), lambda p: p["s"]), "").alias("label"))
    return made.join(labels, keys, "left").withColumn("label", F.coalesce("label", F.lit("")))


def suffix_keys(branches: DataFrame) -> DataFrame:
    """Branch rows of a suffix index, whose keys are stored reversed, with `key` the right way round; absent chunks have no rows."""
    keys = ["package_id", "component", "logical_block", "row_idx"]
    return branches.join(decoded_keys(branches.withColumn("key_bytes", F.unhex("key_hex")), keys), keys, "left").withColumn("key", F.reverse(F.coalesce("own_key", F.lit("")))).drop("own_key")


def chunk_presence(comps: DataFrame) -> DataFrame:
    """(package_id, component, chunks, present, complete): how many of a component's chunks begin inside its file."""
    place = lambda k: be(F.col("content"), k * 4 + 64, 4)
    each = comps.filter("status = 'ok' and n_chunks > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).withColumn("at", place(F.col("k")))
    made = each.groupBy("package_id", "component").agg(F.count("*").alias("chunks"), F.count_if(F.col("at") + 5 <= F.col("size")).alias("present"))
    return made.withColumn("complete", F.col("chunks") == F.col("present"))
