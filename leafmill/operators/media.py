"""Media references in streams and the records that they point at."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.bytes import BLOCK, bitmap_size, content_kind, le, packed_decimal
from leafmill.sources.packages import CHUNK
from leafmill.staging import scratch

from .windows import preceding_within

# Fixed values of the format.
WRAP = b"data"
SECTION_REACH = 96


def references(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, kind, section_code, start_block, start_offset, end_block, end_offset) of image and audio references.

    An image reference has its pointer in the last six of 18 payload bytes, an audio range
    two pointers from the fifth of 16 on, in packed decimal; others that don't read so go.
    """
    marked = preceding_within(decoded, keys, "start", SECTION_REACH, F.when(F.col("kind") == "section", F.col("payload")), "section_code")
    digits = lambda at, n: packed_decimal(F.substring("payload", 2 * at + 1, 2 * n))
    image, audio = (F.col("op") == "4d") & (F.length("payload") == 36), (F.col("op") == "4a") & (F.length("payload") == 32)
    rows = marked.filter(image | audio).withColumn("media", F.when(image, "image").otherwise("audio"))
    is_image = F.col("media") == "image"
    rows = rows.select(
        *keys, "start", F.col("media").alias("kind"), "section_code", F.when(is_image, digits(12, 4)).otherwise(digits(4, 4)).alias("start_block"), F.when(is_image, digits(16, 2)).otherwise(digits(8, 2)).cast("int").alias("start_offset"),
        F.when(~is_image, digits(10, 4)).alias("end_block"), F.when(~is_image, digits(14, 2)).cast("int").alias("end_offset"),
    )
    return rows.filter("start_block is not null and start_offset is not null and (kind = 'image' or (end_block is not null and end_offset is not null))")


def audio_size(start_block: Column, start_offset: Column, end_block: Column, end_offset: Column, inclusive: bool) -> Column:
    """Bytes of an audio range; its end is its last byte (inclusive) or the byte after it."""
    return ((end_block - start_block) * BLOCK + end_offset - start_offset + (1 if inclusive else 0)).cast("long")


def records(stored: DataFrame, data: str = "bytes") -> DataFrame:
    """stored (bytes at a pointer) with status, media_type, mime, size, width, height and the payload of a wrapped image record."""
    wrapped = F.startswith(data, F.lit(WRAP))
    size = le(F.col(data), 4, 4)
    body = F.substr(data, F.lit(9), size.cast("int"))
    whole = F.octet_length(data) >= size + 8
    status = F.when(~wrapped, "not_a_record").when(size <= 0, "empty").when(~whole, "truncated").otherwise("ok")
    rows = stored.withColumn("status", F.coalesce(status, F.lit("not_a_record"))).withColumn("size", F.when(wrapped, size)).withColumn("payload", F.when(F.col("status") == "ok", body))
    kind, dims = content_kind(F.col("payload")), bitmap_size(F.col("payload"))
    rows = rows.withColumn("media_type", kind["kind"]).withColumn("mime", kind["mime"])
    jpeg = jpeg_size(F.when(F.col("media_type") == "jpeg", F.col("payload")))
    return rows.withColumn("j", jpeg).withColumn("width", F.coalesce(dims["width"], F.col("j.width"))).withColumn("height", F.coalesce(dims["height"], F.col("j.height"))).drop("j")


def jpeg_size(data: Column) -> Column:
    """struct(width, height) from the first frame header; the walk goes from segment to segment and never scans pixels."""

    def one(b: bytes | None) -> dict | None:
        at = 2
        while b is not None and at + 9 < len(b) and b[at] == 0xFF:
            marker, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return {"width": int.from_bytes(b[at + 7 : at + 9], "big"), "height": int.from_bytes(b[at + 5 : at + 7], "big")}
            at += 1 if marker == 0xFF else 2 + (0 if marker == 0x01 or 0xD0 <= marker <= 0xD9 else max(size, 2))
        return None

    def mapped(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) or {"width": None, "height": None} for v in values], columns=["width", "height"]).astype("Int64")

    return F.pandas_udf(mapped, "struct<width:bigint,height:bigint>")(data)


def _audio(data: bytes | None) -> dict | None:
    """Fields of a RIFF wave, of bare wave chunks, or of MPEG audio; the walk goes from chunk to chunk."""
    if not data:
        return None
    none = {"kind": None, "channels": None, "rate": None, "bits": None, "data_offset": None, "data_size": None}
    whole = data[:4] == b"RIFF" and data[8:12] == b"WAVE"
    at, found = 12 if whole else 0, {}
    while at + 8 <= len(data) and all(32 <= x < 127 for x in data[at : at + 4]):
        tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > len(data) and tag != b"data":
            break
        found.setdefault(tag, (at + 8, min(size, len(data) - at - 8)))
        if tag == b"data":
            break
        at += 8 + size + size % 2
    if b"fmt " in found and found[b"fmt "][1] >= 16:
        f = found[b"fmt "][0]
        start, size = found.get(b"data", (None, None))
        number = lambda k, n: int.from_bytes(data[f + k : f + k + n], "little")
        return {"kind": "wave" if whole else "wave_chunks", "channels": number(2, 2), "rate": number(4, 4), "bits": number(14, 2), "data_offset": start, "data_size": size}
    at = 10 + sum((x & 127) << 7 * (3 - k) for k, x in enumerate(data[6:10])) if data[:3] == b"ID3" and len(data) >= 10 else 0
    if len(data) >= at + 4 and data[at] == 0xFF and data[at + 1] & 0xE0 == 0xE0:
        version, rate = data[at + 1] >> 3 & 3, data[at + 2] >> 2 & 3
        hertz = (44100, 48000, 32000)[rate] >> {3: 0, 2: 1, 0: 2}.get(version, 0) if rate < 3 else None
        return none | {"kind": "mp3", "channels": 1 if data[at + 3] >> 6 == 3 else 2, "rate": hertz, "data_offset": at, "data_size": len(data) - at}
    return None


AUDIO = "struct<kind:string,channels:bigint,rate:bigint,bits:bigint,data_offset:bigint,data_size:bigint>"


def audio_header(data: Column) -> Column:
    """struct(kind, channels, rate, bits, data_offset, data_size) of waves, wave chunks without a RIFF head, and MPEG audio; null fields for others."""

    def mapped(values: pd.Series) -> pd.DataFrame:
        names = ["kind", "channels", "rate", "bits", "data_offset", "data_size"]
        found = [_audio(v) or {} for v in values]
        kinds = {n: object if n == "kind" else "Int64" for n in names}
        return pd.DataFrame({n: pd.Series([f.get(n) for f in found], dtype=kind) for n, kind in kinds.items()})

    return F.pandas_udf(mapped, AUDIO)(data)


def wave_format(data: Column) -> Column:
    """struct(channels, rate, bits, bytes) of RIFF waves, wherever their format chunk stands; null for others."""
    head = audio_header(data)
    return F.when(head["kind"] == "wave", F.struct(head["channels"].alias("channels"), head["rate"].alias("rate"), head["bits"].alias("bits"), le(data, 4, 4).alias("bytes")))


def _little(value: Column, n: int) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(0xFF)), 2, "0") for k in range(n)]))


def riff_wrapped(chunks: Column) -> Column:
    """Wave chunks with the head that makes them a file; what has one stays as it is."""
    made = F.concat(F.lit(b"RIFF"), _little(F.octet_length(chunks) + 4, 4), F.lit(b"WAVE"), chunks)
    return F.when(F.startswith(chunks, F.lit(b"RIFF")), chunks).otherwise(made)


def file_names(payloads: DataFrame, within: list[str], number: str, name: str, data: str) -> DataFrame:
    """payloads with file_name: their name made safe, with an extension by content, and their number before it where an earlier one has the name."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("media_"), number)), "[^0-9A-Za-z._-]+", "_"), "^[._]+|[._]+$", "")
    stem = F.when(stem == "", F.concat(F.lit("media_"), number)).otherwise(stem)
    kind = content_kind(F.col(data))["kind"]
    made = F.when(stem.rlike(r"[^.]\.[^.]+$"), stem).otherwise(F.concat(stem, F.lit("."), F.when(kind == "unknown", "bin").when(kind == "riff", "wav").otherwise(kind)))
    rows = payloads.withColumn("file_name", made)
    place = F.row_number().over(Window.partitionBy(*within, "file_name").orderBy(number))
    return rows.withColumn("nth_", place).withColumn("file_name", F.when(F.col("nth_") == 1, F.col("file_name")).otherwise(F.concat(F.lpad(F.col(number).cast("string"), F.greatest(F.lit(5), F.length(F.col(number).cast("string"))), "0"), F.lit("_"), "file_name"))).drop("nth_")


def write_files(named: DataFrame, path: str, folder: str, name: str = "file_name", data: str = "payload") -> DataFrame:
    """Write each payload to path/folder/name, from the tasks; (folder, name, bytes) of what was written. path is a URI that all executors reach."""
    rows = named.select(F.col(folder).cast("string").alias("folder"), F.col(name).alias("name"), F.col(data).alias("data"))

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            store, base = fs.FileSystem.from_uri(path)
            for f, n, d in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                store.create_dir(f"{base}/{f}", recursive=True)
                with store.open_output_stream(f"{base}/{f}/{n}") as out:
                    out.write(d)
            yield pa.RecordBatch.from_pydict({"folder": batch.column(0), "name": batch.column(1), "bytes": pa.array([len(d) for d in batch.column(2).to_pylist()], pa.int64())})

    return scratch(rows.mapInArrow(run, "folder string, name string, bytes long"), "written")


def referenced(refs: DataFrame, expanded: DataFrame, inclusive: bool = False) -> DataFrame:
    """refs (package_id, start_block, start_offset, size) with the bytes of their range, put together from the chunks that hold it.

    The chunk table's start_block says where a component begins. A range in no chunk keeps null bytes.
    """
    at = F.col("start_block") * BLOCK + F.col("start_offset")
    keyed = refs.withColumn("ref_", F.monotonically_increasing_id()).withColumn("at_", at.cast("long"))
    keyed = scratch(keyed.withColumn("end_", F.col("at_") + F.col("size") + (1 if inclusive else 0)), "refs")
    held = expanded.select("package_id", (F.col("start_block") * BLOCK + F.col("chunk_idx").cast("long") * CHUNK).alias("base"), "bytes")
    # A chunk begins at a multiple of a block, so it is dealt to the buckets of a chunk's width that it overlaps.
    dealt = held.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor(F.col("base") / CHUNK), F.floor((F.col("base") + F.octet_length("bytes") - 1) / CHUNK)))))
    asked = keyed.filter("end_ > at_").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at_") / CHUNK), F.floor((F.col("end_") - 1) / CHUNK))))
    low, high = F.greatest("at_", "base"), F.least("end_", F.col("base") + F.octet_length("bytes"))
    # A bucket's own part only, so that a chunk in two buckets doesn't count twice.
    low, high = F.greatest(low, F.col("bucket") * CHUNK), F.least(high, (F.col("bucket") + 1) * CHUNK)
    met = asked.join(dealt, ["package_id", "bucket"]).withColumn("low", low).withColumn("high", high).filter("low < high")
    part = F.substr("bytes", (F.col("low") - F.col("base") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    joined = met.select("ref_", "low", part.alias("part")).groupBy("ref_").agg(F.array_sort(F.collect_list(F.struct("low", "part"))).alias("parts"))
    body = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["part"]))
    return keyed.join(joined.select("ref_", body.alias("bytes")), "ref_", "left").select(*refs.columns, "bytes")


def summary(recs: DataFrame) -> DataFrame:
    """(media_type, width, height, n, duplicates): composite counts and how many payloads repeat another."""
    return recs.filter("status = 'ok'").groupBy("media_type", "width", "height").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(F.sha2("payload", 256))).alias("duplicates"))


def glyph_png(width: Column, height: Column, glyph: Column) -> Column:
    """A one-bit glyph as a grey PNG with its ink black."""

    def png(w: int, h: int, bits: bytes) -> bytes:
        row = (w + 7) // 8
        lines = b"".join(b"\0" + bytes(255 - x for x in bits[k * row : (k + 1) * row]) for k in range(h))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 1, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    def mapped(w: pd.Series, h: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([png(int(a), int(b), bytes(c)) for a, b, c in zip(w, h, g, strict=True)], dtype=object)

    return F.pandas_udf(mapped, "binary")(width, height, glyph)


def glyph_bmp(width: Column, height: Column, glyph: Column) -> Column:
    """A one-bit glyph as a BMP with its ink black; rows are padded to four bytes and stand bottom up."""

    def bmp(w: int, h: int, bits: bytes) -> bytes:
        row = (w + 7) // 8
        lines = b"".join(bytes(255 - x for x in bits[k * row : (k + 1) * row]).ljust(-(-row // 4) * 4, b"\0") for k in reversed(range(h)))
        head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 1, 0, len(lines), 2835, 2835, 2, 2) + b"\0\0\0\0\xff\xff\xff\0"
        return b"BM" + struct.pack("<IHHI", 14 + len(head) + len(lines), 0, 0, 14 + len(head)) + head + lines

    def mapped(w: pd.Series, h: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([bmp(int(a), int(b), bytes(c)) for a, b, c in zip(w, h, g, strict=True)], dtype=object)

    return F.pandas_udf(mapped, "binary")(width, height, glyph)
