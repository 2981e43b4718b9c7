"""Report diff: nested values flattened to paths, joined in full, compared null-safely."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flattened(value: object, path: str = "") -> list[tuple[str, str]]:
    """(path, JSON scalar): a.b[0].c; empty objects and lists have no path."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flattened(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in flattened(v, f"{path}[{k}]")]
    return [(path, json.dumps(value, ensure_ascii=False, sort_keys=True))]


def _paths(text: str | None) -> list[dict]:
    try:
        return [{"path": p, "value": v} for p, v in flattened(json.loads(text))] if isinstance(text, str) else []
    except ValueError:
        return []


def json_paths(text: Column) -> Column:
    """Paths of a JSON text; none of a text that isn't JSON."""

    def mapped(texts: pd.Series) -> pd.Series:
        return texts.map(_paths)

    return F.pandas_udf(mapped, "array<struct<path:string,value:string>>")(text)


def flat_paths(reports: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """(keys, path, value) of each report."""
    return reports.select(*keys, F.explode(json_paths(F.col(body))).alias("p")).select(*keys, "p.path", "p.value")


def changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change, old_value, new_value): added, removed or changed. A null value isn't an absent key."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("in_old"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return a.join(b, keys, "full_outer").withColumn("change", change).filter("change is not null").select(*keys, "change", "old_value", "new_value")
