"""Reports as text: JSON Lines, canonical JSON, CSV with nested values, tab-separated lines, Markdown rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import escaped


def sorted_struct(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A struct of columns in the order of their names, nested structs too, so that its JSON is canonical."""

    def ordered(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            made = F.struct(*[ordered(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
            return F.when(value.isNotNull(), made)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: ordered(x, kind.elementType))
        return value

    wanted = sorted(columns or df.columns)
    return F.struct(*[ordered(df[c], df.schema[c].dataType).alias(c) for c in wanted])


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text for each row, with sorted keys and nulls kept."""
    return df.select(F.to_json(sorted_struct(df, columns), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON Lines, a folder for each value of `by`."""
    writer = df.write.option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as compact JSON, for CSV."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def tab_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tab-joined lines with white space collapsed."""
    clean = [F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " ")) for c in columns]
    return flat(df).select(F.concat_ws("\t", *clean).alias("value"))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Table rows with pipes escaped."""
    safe = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |")).alias("value"))


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as Parquet in a folder of its name, and (name, rows) of what was written."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    counts = [(name, spark.read.parquet(f"{path}/{name}").count()) for name in tables]
    made = spark.createDataFrame(counts, "name string, rows long")
    made.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return made


def write_pages(rendered: DataFrame, path: str, title: str = "headword", html: str = "html", by: str = "package_id") -> None:
    """One HTML document for each entry, a line of a text file each, a folder for each package."""
    page = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), escaped(F.col(title)), F.lit("</title></head><body>"), F.regexp_replace(html, "[\\r\\n]", " "), F.lit("</body></html>"))
    rendered.select(by, page.alias("value")).write.partitionBy(by).text(path)


def linear_book(expanded: DataFrame) -> DataFrame:
    """(package_id, place, bytes): each chunk at its place in one book, (start_block - 1) * 2048 from its component's first."""
    place = (F.col("start_block") - 1) * 2048 + F.col("chunk_idx").cast("long") * 32768
    return expanded.select("package_id", place.alias("place"), "bytes")
