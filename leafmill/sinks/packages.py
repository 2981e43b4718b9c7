"""Packages from entries: body, title and index components and a catalog, one row for each file.

Entries, index rows, pages and chunks are rows throughout. Where an entry's bytes stand in
its package is a running sum over all entries; an index row's page is its running size cut
into equal shares; a chunk gathers the pieces that overlap it and is compressed by itself.
Only the last step meets a component's chunks, as a file is one value; the format bounds it
(65,535 chunks of 32 KiB).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.bytes import BLOCK
from leafmill.operators import ranks
from leafmill.sources.packages import CATALOG_MAGIC, CHUNK, COMPONENT_MAGIC, ENTRY_MARK, RECORD, WINDOW
from leafmill.staging import scratch

BREAK = b"\x1f\x0a"
HEAD, HEAD_END = b"\x1f\x41\x00\x00", b"\x1f\x61"
HALF, HALF_END = b"\x1f\x04", b"\x1f\x05"
FIRST_BLOCK = 2
#: The placeholder cell.
NO_CELL = b"\x22\x2e"
LEAF, FIRST_SIBLING, LAST_SIBLING = 0x8000, 0x4000, 0x2000
LONGEST_KEY, LONGEST_COPY = 254, 15
#: Bytes of records that a leaf page is dealt; with one more record it still holds them.
SHARE = BLOCK - 4 - (1 + LONGEST_KEY + 12)
#: Levels that a tree can have: pages hold seven keys at least.
LEVELS = 12
#: (component, type, stream) in the order of their blocks.
PARTS = [("BODY.BIN", 0x00, "body"), ("TITLE.BIN", 0x05, "title"), ("INDEX.BIN", 0x91, "index")]


#: Cells of characters met so far; a plain dictionary goes to tasks by value.
_CELLS: dict[str, bytes] = {}


def _cell_of(c: str) -> bytes:
    if c not in _CELLS:
        wide = "　" if c == " " else "−" if c == "-" else chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c
        raw = wide.encode("iso2022_jp", "ignore").removeprefix(b"\x1b$B").removesuffix(b"\x1b(B")
        _CELLS[c] = raw if len(raw) == 2 else NO_CELL
    return _CELLS[c]


def cells(text: str) -> bytes:
    """Text as two-byte cells, ASCII by its full-width forms; what has no cell becomes the placeholder cell."""
    return b"".join([_CELLS.get(c) or _cell_of(c) for c in text])


def compressed(data: bytes) -> bytes:
    """A chunk as three-byte commands: a copy of up to LONGEST_COPY bytes from the last place where the next three stood, then a literal."""
    flat = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(flat)
    before, length = np.full(n, -1), np.zeros(n, np.int64)
    if n > 2:
        grams = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        at = np.flatnonzero((before >= 0) & (np.arange(n) - before < WINDOW))
        for k in range(LONGEST_COPY):
            at = at[at + k < n - 1]  # a literal ends every command
            at = at[flat[at + k] == flat[before[at] + k]]
            length[at] += 1
    starts, at, lens = [], 0, length.tolist()
    while at < n:
        starts.append(at)
        at += lens[at] + 1
    own = np.array(starts, np.int64)
    many = length[own]
    back = np.where(many > 0, (WINDOW - own + before[own]) % WINDOW, 0)
    commands = np.stack([back >> 4, (back & 15) << 4 | many, flat[own + many]], axis=1).astype(np.uint8)
    return bytes(2) + len(own).to_bytes(2, "big") + bytes(1) + commands.tobytes()


def catalog(title: str, parts: list[tuple[str, int, int, int]]) -> bytes:
    """The catalog of components (name, type, first block, last block)."""
    named = title.encode("cp932")
    head = bytearray(0x80)
    head[:8], head[12], head[0x4D] = CATALOG_MAGIC, len(named), len(parts)
    head[13 : 13 + len(named)] = named
    records = b""
    for name, kind, first, last in parts:
        record = bytes(3) + bytes([kind]) + first.to_bytes(4, "big") + last.to_bytes(4, "big") + bytes(4) + bytes([len(name)]) + name.encode("ascii")
        records += record.ljust(RECORD, b"\0")
    return bytes(head) + records


def component_file(chunks: list[bytes], first: int, last: int, kind: int) -> bytes:
    """A component of compressed chunks: its header, the places of the chunks, and the chunks."""
    head = bytearray(64)
    head[:8], head[15] = COMPONENT_MAGIC, kind
    head[0x16:0x18] = len(chunks).to_bytes(2, "big")
    head[0x18:0x20] = first.to_bytes(4, "big") + last.to_bytes(4, "big")
    ends = np.cumsum([64 + 4 * len(chunks)] + [len(c) for c in chunks])
    return bytes(head) + ends[:-1].astype(">u4").tobytes() + b"".join(chunks)


def _number(value: Column, n: int) -> Column:
    """An integer as n big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n, "0"))


def _end_to_end(parts: Column, field: str) -> Column:
    """The binary fields of sorted structs, one after the other."""
    return F.encode(F.array_join(F.transform(parts, lambda p: F.decode(p[field], "ISO-8859-1")), ""), "ISO-8859-1")


def _sizes(headword: Column, text: Column) -> dict[str, Column]:
    """Bytes of an entry's body and title before it is encoded: every character is a cell of two bytes."""
    named, shown = 2 * F.length(headword), 2 * F.length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = 1 + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    half = len(HALF + HALF_END)
    body = len(ENTRY_MARK + HEAD + HEAD_END + BREAK) + half + named + shown + lines * (half + len(BREAK))
    return {"body_place": body, "title_place": named + half + len(BREAK)}


def _encoded(entries: DataFrame) -> DataFrame:
    """entries (package, order, headword, text and their places) with key, body and title, their bytes, for headword and text."""

    def run(batches):
        for batch in batches:
            keys, bodies, titles = [], [], []
            for head, lines in zip(batch.column("headword").to_pylist(), batch.column("text").to_pylist(), strict=True):
                named = cells(head)
                shown = BREAK.join([HALF + cells(line) + HALF_END for line in lines.split("\n")])
                keys.append(named[:LONGEST_KEY])
                bodies.append(ENTRY_MARK + HEAD + HALF + named + HALF_END + HEAD_END + BREAK + shown + BREAK)
                titles.append(HALF + named + HALF_END + BREAK)
            kept = [batch.column(c) for c in ("package", "order", "body_place", "title_place")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.binary()) for x in (keys, bodies, titles))], names=["package", "order", "body_place", "title_place", "key", "body", "title"])

    kind = entries.schema["order"].dataType.simpleString()
    return entries.mapInArrow(run, f"package string, order {kind}, body_place long, title_place long, key binary, body binary, title binary")


def _placed(rows: DataFrame, order: list[str], sizes: dict[str, Column]) -> DataFrame:
    """rows with the place of each value within its package, in the given order: running sums over all rows less those of the packages before."""
    summed = ranks.running(rows, ["package", *order], None, sizes).withColumns({f"before_{name}": F.col(name) - n for name, n in sizes.items()})
    bases = summed.groupBy("package").agg(*[F.min(f"before_{name}").alias(f"base_{name}") for name in sizes])
    met = summed.join(bases, "package")
    return met.select(*rows.columns, *[(F.col(f"before_{name}") - F.col(f"base_{name}")).alias(name) for name in sizes])


def _tree(leaves: DataFrame) -> DataFrame:
    """(package, width, per, p0 ...): bytes of a branch key, rows of a branch page, pages of each level from the leaves up; null above the root."""
    made = leaves.groupBy("package").agg((F.max("page") + 1).cast("long").alias("p0"), F.greatest(F.lit(2), F.max(F.octet_length("high"))).alias("width"))
    made = made.withColumn("per", F.floor((BLOCK - 4) / (F.col("width") + 4)))
    for k in range(1, LEVELS):
        made = made.withColumn(f"p{k}", F.when(F.col(f"p{k - 1}") > 1, F.ceil(F.col(f"p{k - 1}") / F.col("per"))))
    return made


def _index_pages(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((package, place, bytes) of all pages, root first, and sizes with index_pages) from (package, key, order, record)."""
    dealt = _placed(rows, ["key", "order"], {"at": F.octet_length("record")}).withColumn("page", F.floor(F.col("at") / SHARE))
    sorted_rows = F.array_sort(F.collect_list(F.struct("key", "order", "record")))
    leaves = scratch(dealt.groupBy("package", "page").agg(sorted_rows.alias("r")).select("package", "page", F.element_at("r", -1)["key"].alias("high"), F.size("r").alias("n"), _end_to_end(F.col("r"), "record").alias("body")), "leaves")
    tree = _tree(leaves)
    upper = lambda k: sum((F.coalesce(F.col(f"p{j}"), F.lit(0)) for j in range(k + 1, LEVELS)), F.lit(0))
    tree = scratch(tree.select("*", upper(-1).alias("index_pages"), *[upper(k).alias(f"s{k}") for k in range(LEVELS)]).join(sizes, "package"), "tree")
    tallest = tree.agg(*[F.max(f"p{k}") for k in range(LEVELS)]).first()
    made, level = None, leaves
    for k in range(sum(x is not None for x in tallest)):
        own = level.join(tree, "package")
        flags = F.when(F.col("page") == 0, FIRST_SIBLING).otherwise(0) + F.when(F.col("page") == F.col(f"p{k}") - 1, LAST_SIBLING).otherwise(0)
        word = (F.lit(LEAF) if k == 0 else F.col("width")) + flags
        page = F.concat(_number(word, 2), _number(F.col("n"), 2), F.col("body"))
        written = own.select("package", ((F.col(f"s{k}") + F.col("page")) * BLOCK).alias("place"), page.alias("page")).select("package", "place", F.expr(f"rpad(page, {BLOCK}, X'00')").alias("bytes"))
        made = written if made is None else made.unionByName(written)
        # The last row of a level is a sentinel; the others have the greatest key below their child.
        last = F.col("page") == F.col(f"p{k}") - 1
        row = own.filter(F.col(f"p{k + 1}").isNotNull()).withColumn("key", F.when(last, F.expr("unhex(repeat('FF', width))")).otherwise(F.expr("rpad(high, width, X'00')")))
        entry = F.concat("key", _number(F.col("index_at") + F.col(f"s{k}") + F.col("page"), 4))
        grouped = row.select("package", F.floor(F.col("page") / F.col("per")).alias("parent"), "page", "high", entry.alias("entry")).groupBy("package", "parent").agg(F.array_sort(F.collect_list(F.struct("page", "high", "entry"))).alias("r"))
        level = grouped.select("package", F.col("parent").alias("page"), F.element_at("r", -1)["high"].alias("high"), F.size("r").alias("n"), _end_to_end(F.col("r"), "entry").alias("body"))
    return made, tree.select("package", "title_at", "index_at", "index_pages")


def packages(entries: DataFrame, package: str, order: str, headword: str, text: str) -> DataFrame:
    """(dir, name, content): the files of a package for each group of entries; `order` is unique within its package."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = entries.select(F.col(package).cast("string").alias("package"), F.col(order).alias("order"), empty(headword).alias("headword"), empty(text).alias("text"))
    # Places come from lengths alone, so entries are encoded once, behind the shuffles.
    placed = scratch(_encoded(_placed(rows, ["order"], _sizes(F.col("headword"), F.col("text")))), "placed")
    blocks = lambda stream: F.ceil(F.max(F.col(f"{stream}_place") + F.octet_length(stream)) / BLOCK)
    sizes = placed.groupBy("package").agg(blocks("body").alias("b"), blocks("title").alias("t")).select("package", (F.col("b") + FIRST_BLOCK).alias("title_at"), (F.col("b") + F.col("t") + FIRST_BLOCK).alias("index_at"))
    point = lambda first, at: F.concat(_number(first + F.floor(at / BLOCK), 4), _number(at % BLOCK, 2))
    record = F.concat(_number(F.octet_length("key"), 1), F.col("key"), point(F.lit(FIRST_BLOCK), F.col("body_place")), point(F.col("title_at"), F.col("title_place")))
    pages, sizes = _index_pages(placed.join(sizes, "package").select("package", "key", "order", record.alias("record")), sizes)
    pieces = pages.select("package", F.lit("index").alias("stream"), "place", "bytes")
    for stream in ("body", "title"):
        pieces = pieces.unionByName(placed.select("package", F.lit(stream).alias("stream"), F.col(f"{stream}_place").alias("place"), F.col(stream).alias("bytes")))
    end = F.col("place") + F.octet_length("bytes")
    spread = pieces.withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("place") / CHUNK), F.floor((end - 1) / CHUNK))))
    low = F.greatest(F.col("place"), F.col("chunk_idx") * CHUNK)
    part = F.substr("bytes", (low - F.col("place") + 1).cast("int"), (F.least(end, (F.col("chunk_idx") + 1) * CHUNK) - low).cast("int"))
    gathered = spread.select("package", "stream", "chunk_idx", low.alias("low"), part.alias("part")).groupBy("package", "stream", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("low", "part"))).alias("parts"))
    raw = gathered.select("package", "stream", "chunk_idx", _end_to_end(F.col("parts"), "part").alias("raw")).withColumn("raw", F.expr(f"rpad(raw, cast(ceil(octet_length(raw) / {BLOCK}) * {BLOCK} as int), X'00')"))

    def squeezed(chunks: pd.Series) -> pd.Series:
        return chunks.map(compressed)

    packed = raw.select("package", "stream", "chunk_idx", F.pandas_udf(squeezed, "binary")(F.col("raw")).alias("packed"))
    listed = packed.groupBy("package", "stream").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "packed"))), lambda c: c["packed"]).alias("chunks")).join(sizes, "package")
    first = F.when(F.col("stream") == "body", FIRST_BLOCK).when(F.col("stream") == "title", F.col("title_at")).otherwise(F.col("index_at")).cast("long")
    last = F.when(F.col("stream") == "body", F.col("title_at")).when(F.col("stream") == "title", F.col("index_at")).otherwise(F.col("index_at") + F.col("index_pages")).cast("long") - 1
    kind, name = (F.create_map(*[F.lit(x) for p in PARTS for x in (p[2], p[k])])[F.col("stream")] for k in (1, 0))

    def filed(chunks: pd.Series, first: pd.Series, last: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([component_file([bytes(c) for c in cs], int(a), int(b), int(k)) for cs, a, b, k in zip(chunks, first, last, kind, strict=True)])

    def listed_parts(title: pd.Series, title_at: pd.Series, index_at: pd.Series, index_pages: pd.Series) -> pd.Series:
        edges = zip(title, title_at, index_at, index_at + index_pages, strict=True)
        return pd.Series([catalog(name, [(PARTS[0][0], PARTS[0][1], FIRST_BLOCK, a - 1), (PARTS[1][0], PARTS[1][1], a, b - 1), (PARTS[2][0], PARTS[2][1], b, c - 1)]) for name, a, b, c in edges])

    made = listed.select(F.col("package").alias("dir"), name.alias("name"), F.pandas_udf(filed, "binary")(F.col("chunks"), first, last, kind).alias("content"))
    cats = sizes.select(F.col("package").alias("dir"), F.lit("CATALOG.IDX").alias("name"), F.pandas_udf(listed_parts, "binary")("package", *[F.col(c).cast("long") for c in ("title_at", "index_at", "index_pages")]).alias("content"))
    return made.unionByName(cats)
