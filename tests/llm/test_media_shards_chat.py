import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat, media, sharding
from tests.llm.fixtures import documents, empty, rows


@pytest.mark.parametrize("n", [0, 1, 64, 65, 2048, 2049, 5000, 70_000])
def test_media_round_trip(n):
    payload = media.padded(bytes(k * 7 % 256 for k in range(n)))
    data = media.encode(payload)
    t = media.tables(data)
    assert media.payload(data, t["samples"]) == payload
    assert (t["codec"], t["width"], t["height"], t["duration"]) == ("raw ", 8, 8, len(payload) / 64 / 25)
    assert t["keyframes"] == t["samples"][::16]
    assert [data[a : a + k] for a, k in t["keyframes"]] == [payload[k : k + 64] for k in range(0, len(payload), 1024)]


def test_media_digest_and_index(spark):
    docs = documents(spark)
    got = media.to_digest(docs).collect()
    assert len(got) == len(rows())
    want = Counter()
    for r in docs.collect():
        p = media.padded((r["text"] or "").encode())
        want[(r["doc_id"], len((r["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    indexed = media.with_index(media.to_media(docs)).collect()
    assert {r["status"] for r in indexed} == {"ok"}
    bad = spark.createDataFrame([(1, bytearray(b"junk" * 9)), (2, None), (3, bytearray(media.encode(bytes(64))[:200]))], "doc_id long, media binary")
    assert {r["status"] for r in media.with_index(bad).collect()} == {"corrupt"}
    assert media.to_digest(empty(spark)).collect() == []


def shards(spark, sizes, keys, limit):
    df = spark.createDataFrame([(k, key, n) for k, (key, n) in enumerate(zip(keys, sizes, strict=True))], "row long, key string, size long").repartition(4)
    return sharding.assign(df, "key", F.col("size"), ["row", "key"], limit).collect()


def test_shards_fit_and_split_only_when_over(spark):
    draw = random.Random(1)
    keys = [f"k{k}" for k in range(1500)]
    sizes = [draw.randint(0, 400) for _ in keys]
    got = shards(spark, sizes, keys, 5000)
    held = defaultdict(int)
    for r in got:
        held[r["shard"]] += r["n_bytes"]
    assert len(got) == 1500 and all(n <= 5000 for n in held.values())
    assert all(r["shard_bytes"] == held[r["shard"]] for r in got)
    bits = {int(r["row"]): bin(int(hashlib.md5(r["key"].encode()).hexdigest()[:15], 16))[2:].zfill(60) for r in got}
    for shard in held:
        assert all(bits[r["row"]].startswith(shard[1:]) for r in got if r["shard"] == shard)
        if len(shard) > 1:
            assert sum(r["n_bytes"] for r in got if bits[r["row"]].startswith(shard[1:-1])) > 5000


def test_hot_key_goes_to_a_chain(spark):
    draw = random.Random(2)
    keys = ["hot"] * 300 + [f"k{k}" for k in range(300)]
    sizes = [draw.randint(1, 90) for _ in keys]
    sizes[0], sizes[1] = 5000, 700  # over the limit, and over half of it
    got = shards(spark, sizes, keys, 1000)
    held = defaultdict(list)
    for r in got:
        held[r["shard"]].append(r["n_bytes"])
    assert sorted(r["row"] for r in got) == list(range(600))
    assert all(sum(v) <= 1000 or v == [5000] for v in held.values())


def test_sharding_odd_rows(spark):
    docs = documents(spark)
    got = sharding.assign(docs, "doc_id", F.octet_length("text"), ["doc_id", "lang"], 20_000)
    assert got.count() == len(rows()) and got.agg(F.sum("n_bytes")).first()[0] == sum(len((r[1] or "").encode()) for r in rows())
    assert sharding.assign(empty(spark), "doc_id", F.octet_length("text"), ["doc_id"]).collect() == []


def test_write_shards(spark, tmp_path):
    got = sharding.assign(documents(spark), "doc_id", F.octet_length("text"), ["doc_id"], 30_000)
    sharding.write_shards(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows())


TURNS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", "more"), (0, 3, "assistant", "yes"),
    (1, 0, "user", "hi"), (1, 1, "assistant", "bad"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"),
    (4, 0, None, None), (4, 1, "assistant", None), (7, 0, "user", "alone"), (7, 0, "user", "alone"),
    (8, 0, "system", "s"), (8, 1, "user", "u"), (9, 0, "system", "s"), (9, 1, "user", "u"), (9, 2, "assistant", "ä\U0001f600"), (None, 1, "user", "x"),
]


def test_preference_pairs(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("clash")).repartition(3)
    got = {r["pair_id"]: r for r in chat.preference_pairs(df, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 1).collect()}
    assert set(got) == {0, 1, 2, 3, 4, None}
    first = got[0]
    assert first["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and first["n_prompt_turns"] == 1 and first["has_both"]
    assert [first["chosen"][s["start"] : s["end"]] for s in first["chosen_loss"]] == ["good<|im_end|>", "yes<|im_end|>"]
    assert [first["rejected"][s["start"] : s["end"]] for s in first["rejected_loss"]] == ["bad<|im_end|>"]
    assert (got[1]["n_prompt_turns"], got[1]["chosen"], got[1]["rejected"]) == (2, "", "")
    assert not got[2]["has_both"] and got[2]["chosen"].startswith("<|im_start|>unknown\n<|im_end|>") and got[2]["n_prompt_turns"] == 0
    assert got[3]["chosen"] == "" and got[3]["rejected"].count("alone") == 2
    assert got[4]["n_prompt_turns"] == 2 and got[4]["chosen"] == ""
    assert [got[4]["rejected"][s["start"] : s["end"]] for s in got[4]["rejected_loss"]] == ["ä\U0001f600<|im_end|>"]


def test_preference_pairs_match_sql(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    made = chat.preference_pairs(df, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 1)
    made = made.withColumns({c: chat.spans_text(F.col(c)) for c in ("chosen_loss", "rejected_loss")})
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TURNS)
    con.execute(chat.ORACLE)
    names = [d[0] for d in con.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in made.collect()))) == sorted(map(str, con.fetchall()))
    assert chat.preference_pairs(df.limit(0), F.col("conv_id"), F.lit(True)).collect() == []


def test_carried_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", 5), (2, "d", "e", "f", 6)], "h long, part string, cell string, at string, bytes int")
    got = sharding.assign(df, "h", F.col("bytes"), ["h", "part", "cell", "at", "bytes"], 3)
    assert sorted((r["h"], r["part"], r["cell"], r["at"], r["bytes"]) for r in got.collect()) == [(1, "a", "b", "c", 5), (2, "d", "e", "f", 6)]
