"""Resumable runs over packages as they arrive: a file stream, decoded batch by batch, each package once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators import streams
from leafmill.sources import packages as source

KEYS = ["package_id", "component", "entry_idx"]


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """(dir, name, content) of files below path, as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(path)
    cut = lambda k: F.regexp_extract("path", r"^(.*)/([^/]*)$", k)
    return read.select(cut(1).alias("dir"), cut(2).alias("name"), "content").filter(~F.col("name").rlike(source.NOISE))


def decode_batch(listed: DataFrame) -> DataFrame:
    """(package_id, headword, text) of the packages whose files are in a batch."""
    expanded = source.chunks(source.components(source.catalogs(listed), listed))
    return streams.entry_text(streams.spans(source.entries(expanded), KEYS), KEYS).select("package_id", "headword", "text")


def run(spark: SparkSession, path: str, out: str, state: str) -> StreamingQuery:
    """Decode what has arrived since the last run and append it, a folder for each batch.

    The state folder remembers the files that are done, so a run that was stopped goes on
    where it was, and a batch that is written again replaces itself. A package's files
    have to arrive together, as a rename of its folder does.
    """

    def write(batch: DataFrame, number: int) -> None:
        decode_batch(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
