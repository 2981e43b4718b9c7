"""Package models, scorecards and resumable runs on written packages."""

from pyspark.sql import functions as F

from leafmill.operators import models, streams
from tests import whole as sink
from leafmill.sources import packages as source
from leafmill.streaming import packages as streaming

KEYS = ["package_id", "component", "entry_idx"]


def listed(spark):
    rows = [(d, n, bytearray(c)) for p in ("good", "bad") for d, n, c in sink.build(p, p, [(f"{p} {k}", f"text {k}") for k in range(4)])]
    rows = [r for r in rows if (r[0], r[1]) != ("bad", "TITLE.BIN")]
    return spark.createDataFrame(rows, "dir string, name string, content binary")


def test_models(spark):
    files = listed(spark)
    comps = source.components(source.catalogs(files), files).cache()
    expanded = source.chunks(comps).cache()
    rows = streams.index_rows(streams.index_leaves(source.pages(expanded.filter("ctype = 145"))))
    edges = models.index_edges(rows, comps).cache()
    assert {(r["package_id"], r["kind"], r["status"]): r["n"] for r in models.edge_counts(edges).collect()} == {(p, k, "resolved"): 4 for p in ("good", "bad") for k in ("index_body", "index_title")}
    odd = spark.createDataFrame([("good", "M", 0, 0, 0), ("good", "M", 1, 0x30000000, 0xFFFF), ("good", "M", 2, 999, 1)], "package_id string, component string, place long, block long, offset int")
    more = models.pointer_edges(odd, comps, "menu_destination")
    assert {r["from_place"]: r["status"] for r in more.collect()} == {0: "null", 1: "selector", 2: "unresolved"}
    coverage = streams.coverage(streams.spans(source.entries(expanded), KEYS), KEYS)
    matrix = models.capabilities(comps, edges.unionByName(more), coverage).cache()
    got = {r["package_id"]: (r["body"], r["indexes"], r["titles"], r["menus"], r["profile"], r["closure"], r["blockers"]) for r in matrix.collect()}
    assert got == {"good": ("yes", "yes", "yes", "n/a", "green", "residual", []), "bad": ("yes", "yes", "no", "n/a", "red", "ready", ["titles:no"])}
    card = {(r["family"], r["key"]): r["n"] for r in models.scorecard(matrix, comps, edges).collect()}
    assert card[("component_status", "title:missing")] == 1 and card[("profile", "red")] == 1 and card[("edge_status", "index_body:resolved")] == 8 and card[("blocker", "titles:no")] == 1
    found = {(r["package_id"], r["code"], r["detail"]) for r in models.inconsistencies(comps, more).collect()}
    assert found == {("bad", "component_missing", "TITLE.BIN"), ("good", "unresolved", "menu_destination")}


def test_roles_differ_by_rule(spark):
    df = spark.createDataFrame([(0x0D, "T"), (0x03, "T"), (0x91, "FKINDEX"), (0x01, "MENU.BIN")], "t int, n string")
    got = [tuple(r) for r in df.select(*[models.role(F.col("t"), F.col("n"), x) for x in ("toolkit", "menu", "verifier")]).collect()]
    assert got == [("title", "other", "other"), ("title", "title", "other"), ("index",) * 3, ("menu",) * 3]
    assert [r[0] for r in df.select(models.index_serves(F.col("n"), "forward")).collect()] == [False, False, True, False]


def test_anchor_edges(spark):
    anchors = spark.createDataFrame([("p", "B", 0, 5), ("p", "B", 1, 10), ("p", "B", 2, 7)], "package_id string, component string, record_idx long, data_id long")
    rows = spark.createDataFrame([("p", 1)], "dir string, id long")
    assert [r["status"] for r in models.anchor_edges(anchors, rows, scale=5).orderBy("from_place").collect()] == ["resolved", "missing_target", "invalid_pointer"]


def test_resumable_runs(spark, tmp_path):
    def arrive(name):
        folder = tmp_path / "in" / name
        folder.mkdir(parents=True)
        for _, file, content in sink.build(name, name, [(f"{name} {k}", "x") for k in range(3)]):
            (folder / file).write_bytes(content)

    def go():
        streaming.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).groupBy(F.element_at(F.split("package_id", "/"), -1).alias("p")).count().collect()

    arrive("one")
    assert {r["p"]: r["count"] for r in go()} == {"one": 3}
    arrive("two")
    assert {r["p"]: r["count"] for r in go()} == {"one": 3, "two": 3}
    assert {r["p"]: r["count"] for r in go()} == {"one": 3, "two": 3}
