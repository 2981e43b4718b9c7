"""Expressions over binary columns: packed decimals, pointers, grid codes, magic numbers, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLOCK = 2048
GRID_FIRST, GRID_ROW = 0x21, 94
MAGIC = [
    ("89504E470D0A1A0A", "png", "image/png"),
    ("FFD8FF", "jpeg", "image/jpeg"),
    ("474946383761", "gif", "image/gif"),
    ("474946383961", "gif", "image/gif"),
    ("424D", "bmp", "image/bmp"),
    ("52494646", "riff", "audio/wav"),
    ("494433", "mp3", "audio/mpeg"),
    ("FFFB", "mp3", "audio/mpeg"),
    ("4F676753", "ogg", "audio/ogg"),
    ("504B0304", "zip", "application/zip"),
    ("53514C69746520666F726D6174203300", "sqlite", "application/vnd.sqlite3"),
    ("25504446", "pdf", "application/pdf"),
]


def be(data: Column, at: Column | int, n: int) -> Column:
    """n bytes from 0-based place `at` as an unsigned big-endian long; null beyond the end."""
    part = F.substring(data, at + 1, n) if isinstance(at, int) else F.substr(data, at + 1, F.lit(n))
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def le(data: Column, at: int, n: int) -> Column:
    whole = F.lit(0).cast("long")
    for k in range(n):
        whole = whole + F.shiftleft(be(data, at + k, 1), 8 * k)
    return whole


def packed_decimal(digits: Column) -> Column:
    """Hexadecimal digits read as decimal; null if any is over 9."""
    return F.when(digits.rlike("^[0-9]+$"), digits.try_cast("long"))


def pointer(data: Column, at: int = 0) -> Column:
    """struct(block, offset, encoding): six bytes, four of block and two of offset, packed decimal or else big-endian."""
    part = lambda k, n: F.hex(F.substring(data, at + k + 1, n))
    decimal = F.hex(F.substring(data, at + 1, 6)).rlike("^[0-9]{12}$")
    return F.struct(
        F.when(decimal, packed_decimal(part(0, 4))).otherwise(be(data, at, 4)).alias("block"),
        F.when(decimal, packed_decimal(part(4, 2))).otherwise(be(data, at + 4, 2)).cast("int").alias("offset"),
        F.when(decimal, "decimal").otherwise("binary").alias("encoding"),
    )


def virtual_selector(block: Column, offset: Column) -> Column:
    """The selector in the top four bits of a block whose rest is zero and whose offset is 0xFFFF; else null."""
    return F.when((offset == 0xFFFF) & (block.bitwiseAND(0x0FFFFFFF) == 0), F.shiftrightunsigned(block, 28))


def grid_code(start: Column, index: Column) -> Column:
    """The index-th two-byte code after start, in rows of GRID_ROW cells from GRID_FIRST; a start outside the grid counts flat."""
    row, cell = F.shiftright(start, 8), start.bitwiseAND(0xFF) - GRID_FIRST
    at = cell + index
    code = (row + F.floor(at / GRID_ROW)) * 256 + at % GRID_ROW + GRID_FIRST
    return F.when(cell.between(0, GRID_ROW - 1), code).otherwise(start + index).cast("long")


def grid_index(start: Column, code: Column) -> Column:
    """The inverse of grid_code for a start inside the grid."""
    place = lambda c: F.shiftright(c, 8) * GRID_ROW + c.bitwiseAND(0xFF) - GRID_FIRST
    return (place(code) - place(start)).cast("long")


def content_kind(data: Column) -> Column:
    """struct(kind, mime) by the first bytes; text and unknown bytes have kind 'unknown'."""
    known = F.lit(None).cast("struct<kind:string,mime:string>")
    for digits, kind, mime in reversed(MAGIC):
        known = F.when(F.startswith(data, F.unhex(F.lit(digits))), F.struct(F.lit(kind).alias("kind"), F.lit(mime).alias("mime"))).otherwise(known)
    return F.coalesce(known, F.struct(F.lit("unknown").alias("kind"), F.lit("application/octet-stream").alias("mime")))


def short_id(text: Column) -> Column:
    """First 12 hexadecimal digits of the SHA-1."""
    return F.substring(F.sha1(text), 1, 12)


def bitmap_size(data: Column) -> Column:
    """struct(kind, width, height, bits) from BMP and PNG headers; null for others."""
    bmp = F.struct(F.lit("bmp").alias("kind"), le(data, 18, 4).alias("width"), le(data, 22, 4).alias("height"), le(data, 28, 2).alias("bits"))
    png = F.struct(F.lit("png").alias("kind"), be(data, 16, 4).alias("width"), be(data, 20, 4).alias("height"), be(data, 24, 1).alias("bits"))
    return F.when(F.startswith(data, F.unhex(F.lit("424D"))), bmp).when(F.startswith(data, F.unhex(F.lit("89504E47"))), png)
