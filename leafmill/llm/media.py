"""ISO base media files in a binary column: write raw 8-bit frames, index them, read them back.

`encode` stores bytes losslessly as 8x8 grey frames of 8-bit samples in one video
track.  `index` walks the nested boxes and decodes the sample tables (sizes, chunk
offsets, chunk runs, durations, sync samples) into codec, duration and the byte
ranges of keyframes; it never looks into the payload.  `payload` follows the
tables to the stored bytes.

Results in odd cases: a null or empty text is 64 zero bytes; equal texts give equal
files; bytes that are no such file give status 'corrupt' and nulls; an empty table
gives an empty table; extra columns are carried.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import release, slices

FRAME = 64
SIDE = 8
TIMESCALE = 25
FRAMES_IN_CHUNK = 32
KEY_EVERY = 16
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(text: bytes) -> bytes:
    return text + bytes(max(FRAME, -(-len(text) // FRAME) * FRAME) - len(text))


def encode(payload: bytes) -> bytes:
    """A file whose frames are the payload, of which the length is a positive multiple of FRAME."""
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_IN_CHUNK)
    keys = range(1, frames + 1, KEY_EVERY)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    runs = [(1, FRAMES_IN_CHUNK, 1)] if chunks > 1 else []
    if rest := frames - (chunks - 1) * FRAMES_IN_CHUNK:
        if not runs or rest != FRAMES_IN_CHUNK:
            runs.append((chunks, rest, 1))

    def moov(first: int) -> bytes:
        offsets = struct.pack(f">I{chunks}I", chunks, *[first + k * FRAMES_IN_CHUNK * FRAME for k in range(chunks)])
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"stco", offsets),
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(13)), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, frames), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = ftyp + moov(len(ftyp) + len(moov(0)) + 8)
    return head + struct.pack(">I", 8 + len(payload)) + b"mdat" + payload


def boxes(data: bytes, start: int, end: int):
    """(kind, start of body, end) of each box between two offsets."""
    while start + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if n == 1:
            (n,), body = struct.unpack_from(">Q", data, body), body + 8
        stop = end if n == 0 else start + n
        if stop < body or stop > end:
            raise ValueError("box runs over its parent")
        yield kind, body, stop
        start = stop


def walk(data: bytes, start: int, end: int, path: tuple[bytes, ...] = ()):
    for kind, body, stop in boxes(data, start, end):
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))


def _table(data: bytes, body: int, width: int) -> list[tuple[int, ...]]:
    (n,) = struct.unpack_from(">I", data, body + 4)
    return list(struct.iter_unpack(f">{width}I", data[body + 8 : body + 8 + 4 * width * n]))


def tables(data: bytes) -> dict:
    """What the boxes of the first track say, and the byte range of each sample."""
    got: dict = {}
    for path, body, stop in walk(data, 0, len(data)):
        got.setdefault(path[-1], (body, stop))
    try:
        mdhd, stsd, stsz = got[b"mdhd"][0], got[b"stsd"][0], got[b"stsz"][0]
        wide = data[mdhd] == 1
        timescale, duration = struct.unpack_from(">IQ", data, mdhd + 20) if wide else struct.unpack_from(">II", data, mdhd + 12)
        codec = data[stsd + 12 : stsd + 16].decode("latin-1")
        width, height = struct.unpack_from(">HH", data, stsd + 8 + 32)
        each, count = struct.unpack_from(">II", data, stsz + 4)
        sizes = [each] * count if each else [x[0] for x in struct.iter_unpack(">I", data[stsz + 12 : stsz + 12 + 4 * count])]
        if b"stco" in got:
            chunks = [x[0] for x in _table(data, got[b"stco"][0], 1)]
        else:
            (n,) = struct.unpack_from(">I", data, got[b"co64"][0] + 4)
            chunks = [x[0] for x in struct.iter_unpack(">Q", data[got[b"co64"][0] + 8 : got[b"co64"][0] + 8 + 8 * n])]
        runs = _table(data, got[b"stsc"][0], 3)
        ticks = sum(n * d for n, d in _table(data, got[b"stts"][0], 2))
        sync = [x[0] for x in _table(data, got[b"stss"][0], 1)] if b"stss" in got else range(1, count + 1)
    except KeyError as e:
        raise ValueError(f"no box {e}") from e
    ranges, sample = [], 0
    for k, (first, many, _) in enumerate(runs):
        last = runs[k + 1][0] if k + 1 < len(runs) else len(chunks) + 1
        for chunk in range(first - 1, last - 1):
            at = chunks[chunk]
            for size in sizes[sample : sample + many]:
                ranges.append((at, size))
                at += size
            sample += many
    if len(ranges) != count or any(not 0 < s <= count for s in sync):
        raise ValueError("sample tables disagree")
    return {"codec": codec, "width": width, "height": height, "timescale": timescale, "duration": ticks / timescale, "header_duration": duration, "samples": ranges, "keyframes": [ranges[s - 1] for s in sync]}


def payload(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The stored bytes, by the sample tables; neighbouring ranges are read at once."""
    parts, start, end = [], 0, 0
    for at, n in ranges:
        if at != end:
            parts.append(data[start:end])
            start = at
        end = at + n
        if end > len(data):
            raise ValueError("sample beyond the file")
    return b"".join([*parts, data[start:end]])


KEYFRAMES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
INDEX = [
    T.StructField("status", T.StringType()), T.StructField("codec", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("duration", T.DoubleType()), T.StructField("n_samples", T.LongType()), T.StructField("keyframes", KEYFRAMES),
]
ARROW_KEYFRAMES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
ARROW_INDEX = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), ARROW_KEYFRAMES]


def _indexed(data: bytes | None) -> tuple:
    try:
        t = tables(data or b"")
    except (ValueError, struct.error, IndexError, ZeroDivisionError):
        return ("corrupt", None, None, None, None, None, None)
    return ("ok", t["codec"], t["width"], t["height"], t["duration"], len(t["samples"]), [{"start": a, "length": n} for a, n in t["keyframes"]])


def _digest(text: bytes, data: bytes) -> tuple:
    t = tables(data)
    back = payload(data, t["samples"])
    keys = t["keyframes"]
    feature = f"codec={t['codec'].strip()};size={t['width']}x{t['height']};frames={len(t['samples'])};seconds={t['duration']:.2f};keyframes={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]}"
    return (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(data), hashlib.sha256(data).hexdigest(), feature)


DIGEST = [
    T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
]
ARROW_DIGEST = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _appended(df: DataFrame, sized: str, fields: list[T.StructField], kinds: list[pa.DataType], one) -> DataFrame:
    """df with fields that `one` makes of each row's bytes in column `sized`, without that column."""
    kept = [f for f in df.schema.fields if f.name != sized and f.name not in {x.name for x in fields}]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part in slices(batch, sized):
                column = part.column(sized)
                column = column.cast(pa.binary()) if pa.types.is_string(column.type) else column
                rows = [one(x) for x in column.to_pylist()]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + made, names=names + [f.name for f in fields])
        release()

    return df.mapInArrow(run, T.StructType(kept + fields))


def to_media(df: DataFrame, text: str = "text") -> DataFrame:
    """The text column becomes `n_bytes` and `media`, the file of its bytes."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return _appended(df, text, fields, [pa.int64(), pa.binary()], lambda x: (len(x or b""), encode(padded(x or b""))))


def with_index(df: DataFrame, media: str = "media") -> DataFrame:
    """The media column becomes status, codec, size, duration, n_samples and keyframe byte ranges."""
    return _appended(df, media, INDEX, ARROW_INDEX, _indexed)


def to_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """The text column becomes digests of its stored file and of what is read back from it."""
    return _appended(df, text, DIGEST, ARROW_DIGEST, lambda x: _digest(x or b"", encode(padded(x or b""))))
