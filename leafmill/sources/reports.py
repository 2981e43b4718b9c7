"""Reports and asset lists as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_NAMES = r"(?i)\.(png|gif|jpe?g|bmp|svg|webp)$"
TEMPLATE_NAMES = r"(?i)\.(html?|css|js|xsl)$"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON Lines files; blank and malformed lines and lines that hold no object are skipped."""
    rows = spark.read.text(path).filter(F.trim("value").startswith("{"))
    parsed = rows.select(F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema)).alias("r"))
    return parsed.filter("r is not null").select("r.*")


def assets(listed: DataFrame) -> DataFrame:
    """(dir, name, kind, stem, theme) of images and templates; a theme is what follows the last underscore of light and dark variants."""
    kind = F.when(F.col("name").rlike(IMAGE_NAMES), "image").when(F.col("name").rlike(TEMPLATE_NAMES), "template")
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    theme = F.regexp_extract(stem, r"_(light|dark)$", 1)
    return listed.select("dir", "name", kind.alias("kind"), F.regexp_replace(stem, r"_(light|dark)$", "").alias("stem"), F.nullif(theme, F.lit("")).alias("theme")).filter("kind is not null")


def asset_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("dir", "kind").agg(F.count("*").alias("n"), F.count("theme").alias("themed"))


def menu_items(listed: DataFrame) -> DataFrame:
    """(dir, name, k, label, href) of items in XML menus, in document order: elements with an href and a title or label."""
    text = F.col("content").cast("string")
    xml = listed.filter(F.lower("name").endswith(".xml"))
    rows = xml.select("dir", "name", F.posexplode(F.regexp_extract_all(text, F.lit(r"<\w+\b([^>]*\bhref\s*=[^>]*)>"), 1)).alias("k", "attrs"))
    value = lambda names: F.regexp_extract("attrs", rf"""\b(?:{names})\s*=\s*["']([^"']*)["']""", 1)
    return rows.select("dir", "name", "k", value("title|label|name").alias("label"), value("href").alias("href"))
