"""Sidecar databases: SQLite files read where Spark finds them, each opened in memory by the task that has its bytes."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value of the format.
MAGIC = b"SQLite format 3\0"
ROWS = 5000


def _opened(content: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(bytes(content))
    return con


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def tables(files: DataFrame) -> DataFrame:
    """(dir, name, tbl, columns, row_count) of every table of every database."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, name, content in frame.itertuples(index=False):
                con = _opened(content)
                for (tbl,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
                    columns = [c[1] for c in con.execute(f"PRAGMA table_info({_name(tbl)})")]
                    rows.append((d, name, tbl, columns, con.execute(f"SELECT count(*) FROM {_name(tbl)}").fetchone()[0]))
                con.close()
            yield pd.DataFrame(rows, columns=["dir", "name", "tbl", "columns", "row_count"])

    own = files.filter(F.startswith("content", F.lit(MAGIC))).select("dir", "name", "content")
    return own.mapInPandas(run, "dir string, name string, tbl string, columns array<string>, row_count long")


def scan(files: DataFrame, tbl: str, schema: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(dir, name, rowid, columns of schema) of one table in every database that has it.

    A column is the first of its aliases that the table has, names without regard to
    case; a column that it lacks is null. Only these columns are read.
    """
    wanted = T._parse_datatype_string(schema)
    names = [f.name for f in wanted.fields]
    alike = {c: [c, *(aliases or {}).get(c, [])] for c in names}
    casts = {f.name: float if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else bytes if isinstance(f.dataType, T.BinaryType) else int if isinstance(f.dataType, (T.IntegerType, T.LongType)) else str for f in wanted.fields}

    def convert(value, kind):
        try:
            return None if value is None else value if kind is bytes and isinstance(value, bytes) else str(value).encode() if kind is bytes else kind(value)
        except (TypeError, ValueError):
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, name, content in frame.itertuples(index=False):
                con = _opened(content)
                there = {c[1].lower(): c[1] for c in con.execute(f"PRAGMA table_info({_name(tbl)})")}
                if there:
                    found = [next((_name(there[a.lower()]) for a in alike[c] if a.lower() in there), "NULL") for c in names]
                    cursor = con.execute(f"SELECT rowid, {', '.join(found)} FROM {_name(tbl)} ORDER BY rowid")
                    while rows := cursor.fetchmany(ROWS):
                        yield pd.DataFrame([(d, name, r[0], *(convert(v, casts[c]) for c, v in zip(names, r[1:], strict=True))) for r in rows], columns=["dir", "name", "rowid", *names]).astype(object)
                con.close()

    own = files.filter(F.startswith("content", F.lit(MAGIC))).select("dir", "name", "content")
    return own.mapInPandas(run, T.StructType([T.StructField("dir", T.StringType()), T.StructField("name", T.StringType()), T.StructField("rowid", T.LongType()), *wanted.fields]))


def csv_entries(spark: SparkSession, path: str) -> DataFrame:
    """(title, html) of CSV files whose headers may be in any case."""
    read = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    by_name = {c.lower().lstrip("﻿"): c for c in read.columns}
    return read.select(*[F.coalesce(F.col(f"`{by_name[c]}`"), F.lit("")).alias(c) if c in by_name else F.lit("").alias(c) for c in ("title", "html")])


def zip_banks(files: DataFrame, least: dict[str, int]) -> DataFrame:
    """(dir, name, kind, bank, row_idx, fields): positional JSON rows of numbered banks in archives; rows shorter than their kind's least go.

    A bank is `<kind>_<number>.json`; its rows are arrays, whose fields come as JSON texts.
    """
    pattern = re.compile(r"^(?:.*/)?(" + "|".join(map(re.escape, least)) + r")_(\d+)\.json$")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, name, content in frame.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for kind, bank, member in sorted((m[1], int(m[2]), m[0]) for n in archive.namelist() if (m := pattern.match(n))):
                        for k, row in enumerate(json.loads(archive.read(member))):
                            if isinstance(row, list) and len(row) >= least[kind]:
                                rows.append((d, name, kind, bank, k, [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in row]))
            yield pd.DataFrame(rows, columns=["dir", "name", "kind", "bank", "row_idx", "fields"])

    own = files.filter(F.startswith("content", F.lit(b"PK\x03\x04"))).select("dir", "name", "content")
    return own.mapInPandas(run, "dir string, name string, kind string, bank long, row_idx long, fields array<string>")
