import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import simhash
from tests.llm.fixtures import documents, empty


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_classes(ids, fps, radius=4):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def planted(n, seed):
    draw = random.Random(seed)
    fps = [draw.getrandbits(64) for _ in range(n)]
    for k in range(0, n, 3):
        fps.append(fps[k] ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5))))
    for _ in range(200):  # a crowd about one fingerprint
        fps.append(fps[0] ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))))
    return fps


def check(spark, fps):
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["fp"]: r["component"] for r in simhash.components(df, "doc_id").collect()}
    want = brute_classes(list(range(len(fps))), fps)
    assert [got[x] for x in signed] == want


def test_components_match_brute_force(spark):
    check(spark, planted(300, 1))


def test_hot_shards_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE_ROWS", 16)
    monkeypatch.setattr(simhash, "FRONTIER", 500)
    check(spark, planted(120, 2))


def test_any_number_of_blocks_gives_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_BLOCKS", 8)
    check(spark, planted(120, 3))


def test_tree_search_is_exact():
    draw = np.random.default_rng(4)
    fp = draw.integers(0, 1 << 63, 50, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, fp[:20] ^ np.uint64(7), fp[5] ^ (np.uint64(1) << np.arange(30, dtype=np.uint64))]))
    unit = np.zeros(len(fp), np.int64)
    forest = simhash.Forest(unit, fp, np.ones(len(fp), bool))
    got = {(int(a), int(b)) for q, n in forest.search(np.arange(len(fp)), unit) for a, b in zip(q, n, strict=True)}
    assert got == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i != j and int(fp[i] ^ fp[j]).bit_count() <= 4}


def test_classes_and_fingerprints(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fp(r["text"]) for r in rows]
    want = brute_classes([r["doc_id"] for r in rows], fps)
    got = simhash.classes(docs).select("doc_id", simhash.fp_hex(F.col("fp")).alias("h"), "component_id").collect()
    assert sorted(map(str, ((r["doc_id"], r["h"], r["component_id"]) for r in got))) == sorted(map(str, ((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True))))


def test_one_of_each_class_stays(spark):
    docs = documents(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    fps = [brute_fp(r["text"]) for r in rows]
    root = {}
    label = brute_classes(list(range(len(rows))), fps)
    for r, c in zip(rows, label, strict=True):
        root.setdefault(c, []).append(r["doc_id"])
    got = [r["doc_id"] for r in kept.collect()]
    want = [min(ids, key=lambda x: (x is None, x)) for ids in root.values()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_classes_without_ids_or_with_the_same_id_stay_apart(spark):
    draw = random.Random(6)
    texts = [" ".join(str(draw.random()) for _ in range(30)) for _ in range(12)]
    rows = [(None if k % 3 == 0 else 1 if k % 3 == 1 else k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows, "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_first(df).collect()) == sorted(texts)


def test_empty(spark):
    assert simhash.classes(empty(spark)).collect() == []
    assert simhash.keep_first(empty(spark)).collect() == []


def test_clashing_columns(spark):
    docs = documents(spark).selectExpr("*", "1 as k_", "2 as f_", "3 as component_id")
    assert simhash.keep_first(docs).columns == docs.columns
    assert simhash.keep_first(docs).count() == simhash.keep_first(documents(spark)).count()
