"""Text streams and index pages as tables, by pattern matching in the JVM.

The grammar of a stream is regular over bytes, so a stream read as Latin-1 text (a
character for each byte) is cut into tokens by one regular expression, and every byte
is in exactly one token. What a token means is looked up: control operators in a
table of their behavior, two-byte cells in a table of 94 x 94 characters, local
glyphs in the package's map. Nesting is a running sum over an entry's tokens.

An index leaf is a run of length-prefixed records. For each length there is one
alternative, so records too are cut by one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.bytes import be
from leafmill.functions.text import escaped, narrowed

from .windows import clipped_depth, filled

#: Parts that streams are dealt over, for each shuffle partition: their tokens are many times as much.
SPREAD = 2

# Fixed values of the format.
PAYLOAD = {
    0x09: 2, 0x1A: 2, 0x1C: 2, 0x36: 12, 0x37: 10, 0x3C: 18, 0x41: 2, 0x44: 10, 0x48: 10, 0x49: 10, 0x4B: 6, 0x4C: 2, 0x4D: 18,
    0x62: 6, 0x63: 6, 0x64: 6, 0xE0: 2, 0xE2: 2, 0xE4: 2, 0xE6: 2,
}
#: Operators whose payload depends on its first bytes, with what they need at least.
MODAL = {0x4A: 2, 0x4E: 2, 0x4F: 34}
#: tag -> (start operators, end operators)
TAGS = {
    "halfwidth": ([0x04], [0x05]), "sub": ([0x06], [0x07]), "literal": ([0x0B], [0x0C]), "sup": ([0x0E], [0x0F]), "italic": ([0x10], [0x11]), "em": ([0x12], [0x13]),
    "url": ([0x3B], [0x5B]), "media": ([0x3C, 0x4D], [0x5C, 0x6D]), "head": ([0x41], [0x61]), "link": ([0x42, 0x43, 0x44, 0x49, 0x4A], [0x62, 0x63, 0x64, 0x69, 0x6A]),
    "bold": ([0xE0], [0xE1]), "private": ([0xE2], [0xE3]),
}
#: Operators that print nothing and pair with nothing.
SILENT = {0x00: None, 0x02: None, 0x03: None, 0x1A: "tab_column", 0x1C: "media_layout", 0x36: "renderer_skip", 0x37: "renderer_skip", 0x48: "renderer_skip", 0x4B: "renderer_skip", 0x4C: "renderer_skip", 0x4E: "renderer_skip", 0x4F: "renderer_skip", 0xE4: "renderer_private", 0xE6: "renderer_private"}
HTML_TAGS = {"bold": "b", "italic": "i", "sub": "sub", "sup": "sup", "em": "em", "head": "h3", "literal": "span", "url": "span"}
LEAF_FLAG, GROUP, TARGETS = 0x8000, 0x80, [0xC0, 0xB0]
#: (component types, records (tag, has a key, bytes before the key, bytes after it)) of leaf pages.
GRAMMARS = [
    ([0x71, 0x72, 0x91, 0x92], [(None, True, 0, 12)]),
    ([0x60], [(None, True, 0, 6)]),
    ([0x70, 0x90], [(0x00, True, 0, 12), (0x80, True, 2, 0), (0xC0, True, 0, 12)]),
    ([0x30], [(0x00, True, 0, 6), (0x80, True, 2, 0), (0xC0, True, 0, 6)]),
    ([0x80], [(0x00, True, 0, 12), (0x80, True, 4, 6), (0xC0, False, 0, 6), (0xB0, False, 0, 6)]),
    ([0x81], [(0x00, True, 0, 12), (0x80, True, 4, 6), (0xC0, False, 0, 6)]),
    ([0xA1], [(0x00, True, 0, 12), (0x80, True, 4, 0), (0xC0, False, 0, 12)]),
]


def _byte(k: int) -> str:
    return f"\\x{k:02x}"


def _low_nibble(*values: int) -> str:
    return "[" + "".join(_byte(h << 4 | v) for h in range(16) for v in values) + "]"


def token_pattern() -> str:
    """One alternative for each kind of token; the last takes any byte, so tokens cover the stream."""
    plain = [f"{_byte(op)}.{{{n}}}" for op, n in sorted(PAYLOAD.items())]
    modal = [
        f"\\x4a(?:.{_low_nibble(0)}.{{12}}|.{_low_nibble(1, 2)}.{{14}}|.{_low_nibble(*range(3, 16))})",
        f"\\x4e(?:{_low_nibble(0)}.{{37}}|{_low_nibble(1, 2)}.{{39}}|{_low_nibble(*range(3, 16))}.)",
        "\\x4f(?:\\x1f\\x6f.{46}|(?!\\x1f\\x6f).{34})",
    ]
    with_payload = "".join(_byte(op) for op in [*sorted(PAYLOAD), 0x4A, 0x4E, 0x4F])
    return "(?s)" + "|".join([
        "\\x00+", f"\\x1f(?:{'|'.join(plain + modal)})", f"\\x1f[{with_payload}].*", f"\\x1f[^{with_payload}]", "\\x1f",
        "\\x11\\x03", "\\n", "[\\x21-\\x7e]{2}", "[\\xa1-\\xfe].", "[\\xa1-\\xfe]", "[\\x20-\\x7e]", ".",
    ])


def control_table(spark: SparkSession) -> DataFrame:
    """(op, tag, step_half, step_private, role, size): behavior of control operators and the payload bytes that they need at least."""
    rows = {}
    for tag, (starts, ends) in TAGS.items():
        for ops, sign in ((starts, 1), (ends, -1)):
            for op in ops:
                rows[op] = (tag, sign * (tag == "halfwidth"), sign * (tag == "private"), "start" if sign > 0 else "end")
    for op, tag in SILENT.items():
        rows[op] = (tag, 0, 0, "silent")
    sizes = PAYLOAD | MODAL
    made = [(f"{op:02x}", *rows.get(op, (None, 0, 0, None)), sizes.get(op, 0)) for op in sorted(rows.keys() | sizes.keys())]
    return spark.createDataFrame(made, "op string, tag string, step_half int, step_private int, role string, size int")


def _cell(code: int) -> str:
    """The character of a two-byte cell by the standard set, else by its extensions; empty if none has it."""
    pair = bytes(divmod(code, 256))
    row, cell = pair[0] - 0x21, pair[1] - 0x21
    lead = (row >> 1) + (0x81 if row < 62 else 0xC1)
    trail = cell + 0x9F if row % 2 else cell + (0x40 if cell < 63 else 0x41)
    for raw, charset in ((b"\x1b$B" + pair + b"\x1b(B", "iso2022_jp"), (bytes([lead, trail]), "cp932"), (bytes([lead, trail]), "shift_jis_2004")):
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            continue
    return ""


def cell_table(spark: SparkSession) -> DataFrame:
    """(cell, char): all 94 x 94 cells that have a character, made from the codecs by rule."""
    codes = [row << 8 | cell for row in range(0x21, 0x7F) for cell in range(0x21, 0x7F)]
    return spark.createDataFrame([(f"{c:04x}", ch) for c in codes if (ch := _cell(c))], "cell string, char string")


def spans(streams: DataFrame, keys: list[str], data: str = "bytes", glyphs: DataFrame | None = None) -> DataFrame:
    """(keys, span, start, end, kind, op, tag, payload, text, normalized, code, hidden, resolved, issue): every byte in one span.

    glyphs: (package_id, code, display), one row a code, joined on package_id, which is then one of the keys.
    """
    # Streams are dealt by their keys while they are bytes; their tokens stay where they are made.
    spark = streams.sparkSession
    dealt = streams.select(*keys, F.col(data).alias("data_")).repartition(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    tokens = dealt.select(*keys, F.posexplode(F.regexp_extract_all(F.decode("data_", "ISO-8859-1"), F.lit(token_pattern()), 0)).alias("span", "token"))
    rows = tokens.withColumn("raw", F.lower(F.hex(F.encode("token", "ISO-8859-1")))).withColumn("n", F.length("token"))
    first = F.substring("raw", 1, 2)
    control = F.startswith("token", F.lit("\x1f"))
    pair = F.col("token").rlike("^[\\x21-\\x7e]{2}$")
    glyph = F.col("token").rlike("(?s)^[\\xa1-\\xfe]")
    rows = rows.withColumn("op", F.when(control, F.substring("raw", 3, 2)).when(F.col("raw") == "1103", "bare_1103"))
    rows = rows.withColumn("cell", F.when(pair, F.col("raw"))).withColumn("code", F.when(glyph, F.col("raw")))
    rows = rows.join(F.broadcast(control_table(spark)), "op", "left").join(F.broadcast(cell_table(spark)), "cell", "left")  # tables of fixed size
    if glyphs is not None:
        rows = rows.join(glyphs.select("package_id", "code", F.col("display").alias("resolved")), ["package_id", "code"], "left")
    else:
        rows = rows.withColumn("resolved", F.lit(None).cast("string"))
    # Places and depths by two windows: running sums, then the least of those that are clipped at zero.
    upto = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    depths = {"half": "step_half", "private": "step_private"}
    rows = rows.withColumns({"end": F.sum("n").over(upto)} | {f"sum_{d}": F.sum(F.coalesce(F.col(step), F.lit(0))).over(upto) for d, step in depths.items()})
    rows = rows.withColumn("start", F.col("end") - F.col("n")).withColumns({d: F.col(f"sum_{d}") - F.least(F.lit(0), F.min(f"sum_{d}").over(upto)) for d in depths})
    cut = control & ((F.col("n") == 1) | (F.coalesce("size", F.lit(0)) + 2 > F.col("n")))
    issue = (
        F.when(cut, "truncated_control").when(control & F.col("role").isNull() & ~F.col("op").isin("09", "0a"), "unknown_control")
        .when(pair & F.col("char").isNull(), "invalid_cell").when(glyph & (F.col("n") == 1), "truncated_glyph")
        .when(~control & ~pair & ~glyph & ~first.isin("00", "0a") & (F.col("raw") != "1103") & ~F.col("token").rlike("^[\\x20-\\x7e]$"), "unknown_byte")
    )
    kind = (
        F.when(first == "00", "padding").when(control & (F.col("n") == 1), "problem").when(F.col("op") == "09", "section").when((F.col("op") == "0a") | (F.col("raw") == "0a"), "break")
        .when(F.col("op").isin("3c", "4d"), "media_ref").when(control & F.col("role").isNull(), "unknown_control").when(F.col("op").isNotNull(), "control")
        .when(pair & F.col("char").isNotNull(), "text").when(glyph, "glyph").when(F.col("token").rlike("^[\\x20-\\x7e]$"), "ascii").otherwise("problem")
    )
    text = F.coalesce("char", F.when(kind == "ascii", F.col("token")))
    return rows.select(
        *keys, "span", "start", "end", kind.alias("kind"), "op", "tag", "role", F.when(control & (F.col("n") > 2), F.substring("raw", 5, 1000)).alias("payload"),
        text.alias("text"), F.when((F.col("half") > 0) & F.col("char").isNotNull(), narrowed(F.col("char"))).otherwise(text).alias("normalized"), "code", "resolved",
        (F.col("private") > 0).alias("hidden"), issue.alias("issue"),
    )


def glyph_text(code: Column, resolved: Column) -> Column:
    """A local glyph's display, or <hXXXX> below B0 and <zXXXX> from there."""
    return F.coalesce(F.nullif(resolved, F.lit("")), F.concat(F.lit("<"), F.when(F.substring(code, 1, 2) < "b0", "h").otherwise("z"), F.upper(code), F.lit(">")))


def _shown() -> Column:
    return F.when(F.col("kind") == "break", "\n").when(F.col("kind") == "glyph", glyph_text(F.col("code"), F.col("resolved"))).otherwise(F.coalesce("normalized", F.lit("")))


def _joined(rows: DataFrame, keys: list[str], shown: Column, name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("span", shown.alias("s"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias(name))


def entry_text(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, headword): visible text of each entry; the head is the first head span's text, else the first line."""
    shown = _shown()
    head = F.when((F.col("tag") == "head") & (F.col("role") == "start"), 1).when((F.col("tag") == "head") & (F.col("role") == "end"), -1).otherwise(0)
    rows = clipped_depth(decoded, keys, ["span"], head, "in_head")
    parts = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("span", shown.alias("s"))))), lambda p: p["s"]), "")
    seen = ~F.col("hidden") & F.col("kind").isin("break", "text", "ascii", "glyph")
    made = rows.groupBy(*keys).agg(parts(seen).alias("text"), parts(seen & (F.col("in_head") > 0) & (F.col("kind") != "break")).alias("head"))
    line = F.get(F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != ""), F.lit(0))
    return made.select(*keys, F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"), F.left(F.coalesce(F.nullif(F.trim("head"), F.lit("")), line, F.lit("")), F.lit(240)).alias("headword"))


def entry_html(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html): escaped text with the tags that HTML has, breaks and media placeholders; hidden spans are left out."""
    tag = F.lit(None)
    for name, element in HTML_TAGS.items():
        extra = "" if element not in ("span", "h3") else f' class="{name}"'
        tag = F.when(F.col("tag") == name, F.when(F.col("role") == "start", f"<{element}{extra}>").otherwise(f"</{element}>")).otherwise(tag)
    shown = F.when(F.col("kind") == "break", "<br>").when(F.col("kind") == "media_ref", F.concat(F.lit('<span class="media" data-ref="'), F.coalesce("payload", F.lit("")), F.lit('"></span>')))
    shown = shown.when(F.col("kind") == "control", F.coalesce(tag, F.lit(""))).otherwise(escaped(_shown()))
    visible = decoded.filter(~F.col("hidden") & F.col("kind").isin("break", "text", "ascii", "glyph", "control", "media_ref"))
    return _joined(visible, keys, shown, "html")


def coverage(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spans, bytes, issues): what the spans of each stream add up to."""
    return decoded.groupBy(*keys).agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.count("issue").alias("issues"))


def strict(decoded: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(spans of streams without an issue, (keys, start, issue) of the first issue of each other stream): errors are rows."""
    errors = decoded.filter("issue is not null").groupBy(*keys).agg(F.min(F.struct("start", "issue")).alias("e")).select(*keys, "e.start", "e.issue")
    return decoded.join(errors.select(*keys), keys, "left_anti"), errors


def checked(decoded: DataFrame) -> DataFrame:
    """decoded, failing at the first span with an issue."""
    said = F.concat(F.lit("stream issue: "), "issue", F.lit(" at "), F.col("start").cast("string"))
    return decoded.withColumn("issue", F.when(F.col("issue").isNotNull(), F.raise_error(said).cast("string")))


def op_counts(decoded: DataFrame, by: list[str]) -> DataFrame:
    return decoded.filter("op is not null").groupBy(*by, "op").agg(F.count("*").alias("n"))


def titles(streams: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_idx, start, text): lines of title streams with the place where each begins."""
    rows = spans(streams, keys)
    line = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("line_idx", F.coalesce(F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(line), F.lit(0)).cast("int") + 1)
    shown = F.when(F.col("kind").isin("text", "ascii", "glyph"), _shown()).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("span", shown.alias("s"))))
    made = numbered.filter("kind <> 'padding'").groupBy(*keys, "line_idx").agg(F.min("start").alias("start"), F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("text"))
    return made.filter("text <> ''")


def _record_pattern(shapes: list[tuple[int | None, bool, int, int]]) -> str:
    """Alternatives for the records of a grammar: a tag, a length byte, and so many bytes; a zero length ends the page."""
    out = []
    for tag, keyed, before, after in shapes:
        lead = "" if tag is None else _byte(tag)
        if not keyed:
            out.append(f"{lead}.{{{after}}}")
            continue
        out += [f"{lead}{_byte(n)}.{{{before + n + after}}}" for n in range(256) if n or tag not in (None, 0)]
    return "(?s)" + "|".join([*out, ".+"])


def index_leaves(pages: DataFrame) -> DataFrame:
    """(package_id, component, page_idx, row_idx, tag, keyed, key_bytes, count_hint, body, title): records of leaf pages in all grammars.

    body and title are struct(block, offset). A record that doesn't fit ends its page.
    """
    leaf = pages.filter(be(F.col("page"), 0, 2).bitwiseAND(LEAF_FLAG) != 0)
    page = F.decode(F.substr("page", F.lit(5), F.lit(4096)), "ISO-8859-1")
    cut = F.lit(None).cast("array<string>")
    for types, shapes in GRAMMARS:
        cut = F.when(F.col("ctype").isin(types), F.regexp_extract_all(page, F.lit(_record_pattern(shapes)), 0)).otherwise(cut)
    rows = leaf.select("package_id", "component", "page_idx", "ctype", be(F.col("page"), 2, 2).alias("count"), F.posexplode(cut).alias("k", "record")).filter("k < count")
    rows = rows.withColumn("raw", F.encode("record", "ISO-8859-1"))
    shapes = [(ctype, -1 if tag is None else tag, tag, keyed, before, after) for types, own in GRAMMARS for ctype in types for tag, keyed, before, after in own]
    known = rows.sparkSession.createDataFrame(shapes, "ctype int, key int, tag int, keyed boolean, before int, after int")  # a table of fixed size
    untagged = [ctype for types, own in GRAMMARS if own[0][0] is None for ctype in types]
    key = F.when(F.col("ctype").isin(untagged), -1).otherwise(F.ascii(F.substring("record", 1, 1)))
    rows = rows.withColumn("key", key).join(F.broadcast(known), ["ctype", "key"])
    lead = F.when(F.col("tag").isNull(), 1).when(F.col("keyed"), 2).otherwise(1)
    rows = rows.withColumn("lead", lead).withColumn("size", F.when(F.col("keyed"), be(F.col("raw"), F.col("lead") - 1, 1).cast("int")).otherwise(0))
    at = F.col("lead") + F.col("before") + F.col("size")
    rows = rows.filter(F.octet_length("raw") == at + F.col("after"))
    header = F.coalesce(F.col("tag") == GROUP, F.lit(False))
    points = lambda d: F.struct(be(F.col("raw"), at + d, 4).alias("block"), be(F.col("raw"), at + d + 4, 2).cast("int").alias("offset"))
    title = F.when((F.col("after") == 12), points(6)).when(header & (F.col("after") == 6), points(0))
    hint = F.when(header, F.when(F.col("before") == 4, be(F.col("raw"), F.col("lead"), 4)).otherwise(be(F.col("raw"), F.col("lead"), 2)))
    return rows.select(
        "package_id", "component", "page_idx", (F.col("k") + 1).alias("row_idx"), "tag", "keyed", F.substr("raw", F.col("lead") + F.col("before") + 1, F.col("size")).alias("key_bytes"),
        hint.alias("count_hint"), F.when(~header, points(0)).alias("body"), title.alias("title"),
    )


def decoded_keys(rows: DataFrame, keys: list[str], data: str = "key_bytes") -> DataFrame:
    """(keys, own_key): key bytes as text, cells and glyphs decoded, full-width ASCII narrowed."""
    decoded = spans(rows.select(*keys, F.col(data).alias("bytes")), keys)
    return _joined(decoded.filter(F.col("kind").isin("text", "ascii", "glyph")), keys, _shown(), "own_key").withColumn("own_key", narrowed(F.col("own_key")))


def index_rows(leaves: DataFrame) -> DataFrame:
    """Leaf rows with key and target_key; grouped targets take the key of the last group header, also of an earlier page.

    A target without a title takes its header's, and else its body's place.
    """
    keys = ["package_id", "component", "page_idx", "row_idx"]
    rows = leaves.drop("key_bytes").join(decoded_keys(leaves, keys), keys, "left")
    header = F.when(F.col("tag") == GROUP, F.struct("own_key", "count_hint", F.col("title").alias("group_title")))
    rows = filled(rows, ["package_id", "component"], ["page_idx", "row_idx"], header, "header")
    grouped = F.coalesce(F.col("tag").isin(TARGETS), F.lit(False))
    out = rows.filter(F.coalesce(F.col("tag") != GROUP, F.lit(True)))
    own = F.coalesce("own_key", F.lit(""))
    key = F.when(grouped, F.coalesce("header.own_key", own)).otherwise(own)
    return out.select(
        *keys, key.alias("key"), F.when(F.col("keyed"), own).otherwise(key).alias("target_key"), "body", F.coalesce("title", F.when(grouped, F.col("header.group_title")), "body").alias("title"), grouped.alias("tagged"),
        F.when(grouped, F.col("header.count_hint")).alias("count_hint"), (grouped & F.col("header").isNull()).alias("continued"),
    )


def page_accounting(pages: DataFrame, leaves: DataFrame) -> DataFrame:
    """(package_id, component, page_idx, stated, read, issue): records that leaf pages state and that were read."""
    word, count = be(F.col("page"), 0, 2), be(F.col("page"), 2, 2)
    stated = pages.filter(word.bitwiseAND(LEAF_FLAG) != 0).select("package_id", "component", "page_idx", count.alias("stated"))
    read = leaves.groupBy("package_id", "component", "page_idx").agg(F.count("*").alias("read"))
    met = stated.join(read, ["package_id", "component", "page_idx"], "left").fillna(0, ["read"])
    return met.withColumn("issue", F.when(F.col("read") < F.col("stated"), "short_page"))


def doc_nodes(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, parent_id, kind, tag, text, payload, parent_tag): an entry's spans as a tree, each node with its open tag's node.

    Start tags are nodes; what stands between a start and its end has it as parent, at any
    depth; a span outside all tags has parent 0. A node's parent is the last start of the
    level above, so starts and the nodes that ask for them meet by entry and level.
    """
    step = F.when(F.col("role") == "start", 1).when(F.col("role") == "end", -1).otherwise(0)
    rows = clipped_depth(decoded.filter(~F.col("hidden")), keys, ["span"], step, "depth")
    start = F.coalesce(F.col("role") == "start", F.lit(False))
    nodes = rows.filter((F.col("role").isNull() | start) & F.col("kind").isin("text", "ascii", "glyph", "break", "media_ref", "section", "control")).withColumn("level", F.col("depth") - F.when(start, 1).otherwise(0))
    opened = nodes.filter(start).select(*keys, F.col("depth").alias("level"), "span", "tag", F.lit(True).alias("opens"))
    before = Window.partitionBy(*keys, "level").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    met = nodes.withColumn("opens", F.lit(False)).unionByName(opened, allowMissingColumns=True)
    parent = F.last(F.when(F.col("opens"), F.struct((F.col("span") + 1).alias("id"), F.col("tag").alias("tag"))), ignorenulls=True).over(before)
    named = met.withColumn("parent", F.when(F.col("level") > 0, parent)).filter(~F.col("opens"))
    return named.select(*keys, (F.col("span") + 1).alias("node_id"), F.coalesce("parent.id", F.lit(0)).cast("int").alias("parent_id"), F.when(start, "inline").otherwise(F.col("kind")).alias("kind"), "tag", F.when(F.col("role").isNull(), _shown()).alias("text"), "payload", F.col("parent.tag").alias("parent_tag"))
