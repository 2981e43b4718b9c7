"""Queries against their SQL on small tables of odd rows: nulls, repeats, unfinished references."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.operators import windows
from leafmill.plans import registry

from .test_oracle import canonical


def same(spark, tmp_path, name, tables):
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    assert len(want) > 0


def test_ancestor_paths(spark, tmp_path):
    roles = ["user", None, "tool", "x", "y", "z"]
    rows = [(k % 3, k, roles[k % 6]) for k in range(20)] + [(1, 4, "again"), (1, 3, "twice"), (1, 5, "thrice"), (None, 2, "lost"), (None, None, "lost"), (2, None, "late"), (2, -1, "low"), (5, 2, "alone"), (6, 1, "a"), (6, 2, "b")]
    same(spark, tmp_path, "ancestor_paths", {"conversations": (rows, "conv_id long, turn long, role string")})


def test_paths_with_a_known_depth(spark):
    tree = spark.createDataFrame([("k", 1, 1, "a"), ("k", 2, 3, "b")], "k string, n int, d int, l string")
    assert [r["path"] for r in windows.paths(tree, "k", "n", "d", "l", 3).orderBy("n").collect()] == [["a"], ["a", "b"]]
    with pytest.raises(Exception, match="deeper than 2"):
        windows.paths(tree, "k", "n", "d", "l", 2).collect()


def test_html_to_plain_full(spark, tmp_path):
    rows = [(k, h) for k, h in enumerate(["<p>a &amp; b</p>", "x &amp", "x &am; &lt;b&gt; &#39; &nbsp;y", "&amp;quot; &amp;amp;", "<br/>&middot;&copy;<BR >", "&copy 1", None, ""])]
    same(spark, tmp_path, "html_to_plain_full", {"pages": (rows, "page_id long, html string")})


def test_composite_key_join(spark, tmp_path):
    same(spark, tmp_path, "composite_key_join", {
        "part": ([(1,), (101,), (101,), (7,), (None,)], "p_partkey long"), "supplier": ([(1,), (201,), (201,), (None,), (8,)], "s_suppkey long"),
        "lineitem": ([(1, 1, 2.0), (101, 201, 3.0), (101, 201, 4.5), (7, 8, 1.0), (1, 301, 1.0), (None, 1, 1.0), (1, None, 1.0), (101, 1, None)], "l_partkey long, l_suppkey long, l_quantity double"),
    })


@pytest.mark.parametrize("name", ["merge_intervals", "uncovered_gaps"])
def test_spans(spark, tmp_path, name):
    day = lambda d: datetime.date(1990, 1, 1) + datetime.timedelta(d)
    rows = [(1, 3, day(10)), (31, 3, day(10)), (2, 3, day(33)), (5, 3, day(58)), (40, 3, day(300)), (-29, 3, day(340)), (7, 4, None), (8, 5, day(0)), (9, 5, None), (None, 5, day(400)), (3, 5, day(400)), (6, None, day(4990)), (None, 6, day(7))]
    same(spark, tmp_path, name, {"orders": (rows, "o_orderkey long, o_custkey long, o_orderdate date")})


def test_gaps_take_one_sort(spark):
    rows = spark.createDataFrame([("k", 1, 2), ("k", 5, 6)], "k string, a long, b long")
    made = windows.gaps(rows, "k", F.lit(0).cast("long"), F.lit(9).cast("long"), "a", "b")
    assert sorted(r[1:] for r in made.collect()) == [(0, 0), (3, 4), (7, 9)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan
