"""Packages of binary components as tables: files, catalogs, components, chunks, pages, slices.

A package is a folder with a catalog and the components that it names. A component
is a run of chunks, each compressed by itself, so a chunk is the row that is
expanded, and everything after it is DataFrame work on chunks, pages and slices.
Errors are rows: a file that is no component has status 'opaque', a missing one
'missing', and neither stops the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.bytes import BLOCK, be

# Fixed values of the format.
CATALOG_MAGIC, COMPONENT_MAGIC = b"SSEDINFO", b"SSEDDATA"
CHUNK, WINDOW = 32768, 4080
RECORD = 48
#: (place of the component count, place of the first record); the first is the canonical one.
LAYOUTS = [(0x4D, 0x80), (0x4C, 0x7F), (0x4C, 0x80), (0x4D, 0x7F)]
ENTRY_MARK = b"\x1f\x09\x00\x01"
ENTRY_LEAD = b"\x1f\x02"
BODY_TYPE = 0x00
TITLE_TYPES = [0x03, 0x04, 0x05, 0x06, 0x07, 0x09, 0x0A, 0x0D]
INDEX_TYPES = [0x30, 0x60, 0x70, 0x71, 0x72, 0x80, 0x81, 0x90, 0x91, 0x92, 0xA1]
NOISE = r"^(\._.*|\.DS_Store|Thumbs\.db|desktop\.ini)$"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(dir, name, content) of all files below path but those that systems leave behind."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    cut = F.regexp_extract("path", r"^(.*)/([^/]*)$", 1), F.regexp_extract("path", r"^(.*)/([^/]*)$", 2)
    return read.select(cut[0].alias("dir"), cut[1].alias("name"), "content").filter(~F.col("name").rlike(NOISE))


def targets(found: DataFrame, prefix: str = "") -> DataFrame:
    """(package_id, family, dir) of package folders (dir, family), once each, in order; a catalog inside a folder that a viewer has claimed is left out.

    The id is the folder's name without the prefix. A claim is looked up by each of a folder's own ancestors.
    """
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    claims = found.filter("family = 'multi_view'").select(F.col("dir").alias("above")).distinct()
    inside = found.filter("family = 'catalog'").select("dir", F.explode(above).alias("above")).join(claims, "above").select("dir").distinct().withColumn("family", F.lit("catalog"))
    named = found.join(inside, ["dir", "family"], "left_anti").distinct().withColumn("package_id", F.regexp_replace(F.element_at(parts, -1), "^" + prefix, ""))
    return named.select("package_id", "family", "dir").orderBy("package_id", "family", "dir")


def name_collisions(listed: DataFrame) -> DataFrame:
    """(dir, folded, names) of names in a folder that differ in case only."""
    return listed.groupBy("dir", F.lower("name").alias("folded")).agg(F.array_sort(F.collect_set("name")).alias("names")).filter(F.size("names") > 1)


def _cp932(raw: Column) -> Column:
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: b.split(b"\0", 1)[0].decode("cp932", "replace") if b is not None else None)

    return F.pandas_udf(decoded, "string")(raw)


def _elements(data: Column, count_at: int, first: int, canonical: bool) -> Column:
    """struct(score, canonical, count, elements) of a catalog read by one layout; null if its records don't fit."""
    count = be(data, count_at, 1)

    def one(k: Column) -> Column:
        rec = F.substr(data, k * RECORD + first + 1, F.lit(RECORD))
        sized = F.substr(rec, F.lit(0x12), be(rec, 0x10, 1).cast("int"))
        ended = F.regexp_extract(F.decode(F.substr(rec, F.lit(0x12), F.lit(RECORD)), "ISO-8859-1"), r"(?s)^([^\x00]*)", 1)
        ascii_ = r"^[\x20-\x7e]+$"
        by_size = F.when(be(rec, 0x10, 1).between(1, RECORD - 0x11), F.decode(sized, "ISO-8859-1"))
        name = F.when(by_size.rlike(ascii_), by_size).otherwise(ended)
        return F.struct(
            k.cast("int").alias("idx"), name.alias("component"), be(rec, 3, 1).cast("int").alias("ctype"), be(rec, 2, 1).cast("int").alias("multi"),
            be(rec, 4, 4).alias("start_block"), be(rec, 8, 4).alias("end_block"), F.substring(rec, 13, 4).alias("data_flags"), name.rlike(ascii_).alias("named"),
        )

    fits = (count > 0) & (count * RECORD + first <= F.octet_length(data))
    elements = F.transform(F.sequence(F.lit(0), count.cast("int") - 1), one)
    score = F.size(F.filter(elements, lambda e: e["named"]))
    return F.when(fits, F.struct(score.alias("score"), F.lit(canonical).alias("canonical"), count.cast("int").alias("count"), elements.alias("elements")))


def catalogs(listed: DataFrame) -> DataFrame:
    """(package_id, title, components array, status): each catalog by the layout that names most components, the canonical of equals."""
    own = listed.filter(F.startswith("content", F.lit(CATALOG_MAGIC)))
    read = F.array_max(F.array_compact(F.array(*[_elements(F.col("content"), a, b, k == 0) for k, (a, b) in enumerate(LAYOUTS)])))
    made = own.select(F.col("dir").alias("package_id"), _cp932(F.substr("content", F.lit(14), be(F.col("content"), 12, 1).cast("int"))).alias("title"), read.alias("r"))
    good = F.coalesce(F.col("r.score") == F.col("r.count"), F.lit(False))
    return made.select("package_id", "title", F.when(good, F.col("r.elements")).alias("elements"), F.when(good, "ok").otherwise("bad_catalog").alias("status"))


def components(cats: DataFrame, listed: DataFrame) -> DataFrame:
    """A row for each component of each catalog with its file, found without regard to case, and its header."""
    rows = cats.filter("status = 'ok'").select("package_id", F.inline("elements")).drop("named")
    there = listed.groupBy(F.col("dir").alias("package_id"), F.lower("name").alias("folded")).agg(F.min_by("content", "name").alias("content"))
    met = rows.withColumn("folded", F.lower("component")).join(there, ["package_id", "folded"], "left").drop("folded")
    plain = F.startswith("content", F.lit(COMPONENT_MAGIC))
    status = F.when(F.col("content").isNull(), "missing").when(plain, "ok").otherwise("opaque")
    return met.withColumn("status", status).withColumn("n_chunks", F.when(plain, be(F.col("content"), 0x16, 2)).cast("int")).withColumn("size", F.octet_length("content"))


def _expanded(raw: bytes) -> bytes:
    """One chunk: three-byte commands, each a copy of up to 15 bytes from at most WINDOW back, then a literal.

    What lies before the chunk's begin is its fill byte. The last command adds nothing
    once whole blocks are full. Runs of commands without a copy are taken as a whole.
    """
    if raw is None or len(raw) < 5:
        return b""
    n = min(int.from_bytes(raw[2:4], "big"), (len(raw) - 5) // 3)
    stated = int.from_bytes(raw[2:4], "big")
    commands = np.frombuffer(raw, np.uint8, 3 * n, 5).reshape(n, 3).astype(np.int64)
    literals, copies = commands[:, 2].astype(np.uint8).tobytes(), (commands[:, 1] & 15).tolist()
    reach = (WINDOW - (commands[:, 0] << 4 | commands[:, 1] >> 4) % WINDOW).tolist()
    fill, out = raw[4], bytearray()

    def room(k: int) -> bool:
        return len(out) < CHUNK and not (k == stated - 1 and len(out) % BLOCK == 0)

    done = 0
    for k in [*np.flatnonzero(commands[:, 1] & 15).tolist(), n]:
        out += literals[done : min(k, n - 1)][: CHUNK - len(out)]
        if k == n:
            if done < n and room(n - 1):
                out += literals[n - 1 :]
            break
        size, place = copies[k], len(out) - reach[k]
        if 0 <= place <= len(out) - size and len(out) + size < CHUNK and k < stated - 1:
            out += out[place : place + size]  # a copy that neither meets itself nor an end goes as a whole
            out += literals[k : k + 1]
            done = k + 1
            continue
        for _ in range(size):
            if not room(k):
                return bytes(out)
            place = len(out) - reach[k]
            out.append(out[place] if place >= 0 else fill)
        if not room(k):
            break
        out += literals[k : k + 1]
        done = k + 1
    return bytes(out)


def expand(raw: Column) -> Column:
    def mapped(chunks: pd.Series) -> pd.Series:
        return chunks.map(_expanded)

    return F.pandas_udf(mapped, "binary")(raw)


def chunks(comps: DataFrame) -> DataFrame:
    """(package_id, component, ctype, start_block, chunk_idx, bytes): expanded chunks, each its own row."""
    data = F.col("content")
    place = lambda k: be(data, k * 4 + 64, 4)
    cut = comps.filter("status = 'ok' and n_chunks > 0").select("package_id", "component", "ctype", "start_block", "content", "n_chunks", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_idx"))
    k = F.col("chunk_idx")
    end = F.when(k + 1 < F.col("n_chunks"), place(k + 1)).otherwise(F.octet_length(data))
    raw = F.substr(data, (place(k) + 1).cast("int"), (end - place(k)).cast("int"))
    # Chunks of a large component go to many tasks before they are expanded.
    dealt = cut.select("package_id", "component", "ctype", "start_block", "chunk_idx", raw.alias("raw")).repartition(2 * comps.sparkSession.sparkContext.defaultParallelism, "package_id", "component", "chunk_idx")
    return dealt.select("package_id", "component", "ctype", "start_block", "chunk_idx", expand(F.col("raw")).alias("bytes"))


def pages(expanded: DataFrame) -> DataFrame:
    """(…, page_idx, logical_block, page): blocks of expanded chunks; page_idx counts from 0."""
    own = expanded.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("bytes") / BLOCK).cast("int") - 1))).filter(F.octet_length("bytes") > 0)
    page = (F.col("chunk_idx") * (CHUNK // BLOCK) + F.col("k")).cast("int")
    return own.select("package_id", "component", "ctype", page.alias("page_idx"), (F.col("start_block") + page).alias("logical_block"), F.substr("bytes", F.col("k") * BLOCK + 1, F.lit(BLOCK)).alias("page"))


def marks(expanded: DataFrame, mark: bytes, lead: bytes = b"") -> DataFrame:
    """(package_id, component, start): places of a mark, those across two chunks too; a lead before it counts with it.

    Each chunk is joined to the last bytes of the one before and the first of the next, so no
    component is put into one task.
    """
    key = ["package_id", "component"]
    edge = len(mark) + len(lead) - 1
    body = F.decode("bytes", "ISO-8859-1")
    rows = expanded.select(*key, "chunk_idx", body.alias("body"))
    heads = expanded.select(*key, (F.col("chunk_idx") - 1).alias("chunk_idx"), F.substring(body, 1, edge).alias("head"))
    tails = expanded.select(*key, (F.col("chunk_idx") + 1).alias("chunk_idx"), (F.expr(f"right(decode(bytes, 'ISO-8859-1'), {len(lead)})") if lead else F.lit("")).alias("tail"))
    rows = rows.join(heads, [*key, "chunk_idx"], "left").join(tails, [*key, "chunk_idx"], "left").fillna("", ["head", "tail"])
    # A mark that begins in this chunk: its end lies at most len(mark) - 1 bytes into the next.
    text = F.concat("tail", "body", F.substring("head", 1, len(mark) - 1))
    quoted = "\\Q" + mark.decode("latin-1") + "\\E"
    parts = rows.select(*key, "chunk_idx", F.length("tail").alias("n_tail"), text.alias("text"), F.posexplode(F.split(text, quoted, -1)).alias("part", "before"))
    own = Window.partitionBy(*key, "chunk_idx").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("part").over(Window.partitionBy(*key, "chunk_idx"))
    placed = parts.withColumn("at", F.sum(F.length("before") + len(mark)).over(own) - len(mark)).withColumn("last", last).filter("part < last")
    led = F.endswith("before", F.lit(lead.decode("latin-1"))) if lead else F.lit(False)
    start = F.col("chunk_idx") * CHUNK + F.col("at") - F.col("n_tail") - F.when(led, len(lead)).otherwise(0)
    return placed.filter(F.col("at") >= F.col("n_tail")).select(*key, start.cast("long").alias("start")).distinct()


def slices(expanded: DataFrame, starts: DataFrame) -> DataFrame:
    """(package_id, component, entry_idx, start, end, bytes): each stream cut at its starts, or whole if it has none.

    A slice joins the chunks that it overlaps and puts its parts together in their order.
    """
    key = ["package_id", "component"]
    sizes = expanded.groupBy(*key).agg(F.sum(F.octet_length("bytes")).alias("size"), F.max(F.regexp_replace(F.hex("bytes"), "00", "") != "").alias("filled"))
    whole = sizes.join(starts.select(*key).distinct(), key, "left_anti").filter("size > 0 and filled").select(*key, F.lit(0).cast("long").alias("start"))
    w = Window.partitionBy(*key).orderBy("start")
    cut = starts.select(*key, "start").unionByName(whole).join(sizes, key).filter("start < size")
    cut = cut.select(*key, F.row_number().over(w).alias("entry_idx"), "start", F.coalesce(F.lead("start").over(w), F.col("size")).alias("end"))
    spread = cut.withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("start") / CHUNK).cast("int"), F.floor((F.col("end") - 1) / CHUNK).cast("int"))))
    met = spread.join(expanded.select(*key, "chunk_idx", "bytes"), [*key, "chunk_idx"])
    base = F.col("chunk_idx").cast("long") * CHUNK
    low = F.greatest(F.col("start") - base, F.lit(0))
    part = F.substr("bytes", (low + 1).cast("int"), (F.least(F.col("end") - base, F.lit(CHUNK)) - low).cast("int"))
    joined = met.groupBy(*key, "entry_idx", "start", "end").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", part.alias("p")))).alias("parts"))
    body = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["p"]))
    return joined.select(*key, "entry_idx", "start", "end", body.alias("bytes"))


def entries(expanded: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Slices of body streams at entry marks and at index targets (package_id, component, start)."""
    body = expanded.filter(F.col("ctype") == BODY_TYPE)
    starts = marks(body, ENTRY_MARK, ENTRY_LEAD)
    if targets is not None:
        led = starts.select("package_id", "component", (F.col("start") + len(ENTRY_LEAD)).alias("start"), F.lit(True).alias("led"))
        # A target just behind a lead means the entry that begins with the lead.
        moved = targets.join(led, ["package_id", "component", "start"], "left").filter("led is null").select("package_id", "component", "start")
        starts = starts.unionByName(moved).distinct()
    return slices(body, starts)
