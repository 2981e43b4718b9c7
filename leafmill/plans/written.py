"""Packages written from the driver's parts, which several queries read."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.sinks import packages as sink
from leafmill.sources import packages as source
from leafmill.staging import exists, scratch

KEYS = ["package_id", "component", "entry_idx"]


#: Tables written in this session, by what they were made of: the queries below read the same packages.
_WRITTEN: dict[tuple, object] = {}


def _once(source_table, name: str, make):
    """make() as a scratch table, written again only where it isn't there any more; tables that aren't read from files are not remembered."""
    read = tuple(sorted(source_table.inputFiles()))
    if not read:
        return scratch(make(), name)
    key = (source_table.sparkSession.sparkContext.applicationId, name, read)
    if key not in _WRITTEN or not exists(_WRITTEN[key]):
        _WRITTEN[key] = scratch(make(), name)
    return _WRITTEN[key]


def files_of(t):
    """A package for each brand: its parts' names as headwords, their types and sizes as text."""
    part = t("part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("headword"), F.concat(F.lit("type "), "p_type", F.lit("\nsize "), F.col("p_size").cast("string")).alias("body"))
    return _once(t("part"), "files", lambda: sink.packages(part, "p_brand", "p_partkey", "headword", "body"))


def chunks_of(files):
    """Expanded chunks, written once: marks, sizes and slices all read them."""
    return _once(files, "chunks", lambda: source.chunks(source.components(source.catalogs(files), files)))
