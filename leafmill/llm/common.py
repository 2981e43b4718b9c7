"""Shared helpers of the training-data operators: table access, scratch tables, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a kernel works on at once; bounds the temporaries of a task.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_as_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null is the empty text."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, sized: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose column `sized` holds about `limit` bytes; a longer row stands alone."""
    sizes = [len(x) if x is not None else 0 for x in (v.as_buffer() if v.is_valid else None for v in batch.column(sized))]
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def map_slices(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, sized: str) -> DataFrame:
    """mapInArrow over slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, sized):
                yield kernel(part)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def release() -> None:
    """Give memory that a finished task held back to the system; workers are used again and share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
