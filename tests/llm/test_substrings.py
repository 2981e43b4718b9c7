import random
import re
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import substrings
from tests.llm.fixtures import documents, empty


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


def check(spark, texts):
    df = spark.createDataFrame([(k, t.decode("utf-8", "ignore")) for k, t in enumerate(texts)], "doc_id long, text string")
    stored = [t.decode("utf-8", "ignore").encode() for t in texts]
    got = {r["doc_id"]: r for r in substrings.dedup(df, fields=("n_removed", "n_spans", "spans", "kept")).collect()}
    for k, want in enumerate(brute(stored, substrings.LENGTH)):
        assert bytes(got[k]["kept"]) == want, k
        assert got[k]["n_removed"] == len(stored[k]) - len(want) == sum(s["end"] - s["start"] for s in got[k]["spans"])
        assert got[k]["n_spans"] == len(got[k]["spans"])


def crafted(seed):
    draw = random.Random(seed)
    noise = lambda n: bytes(draw.choice(b"abcdefghij klmnop") for _ in range(n))
    shared = noise(2000)
    texts = [noise(draw.randint(0, 900)) + shared[a : a + n] + noise(draw.randint(0, 700)) for a, n in ((draw.randint(0, 1500), draw.randint(380, 500)) for _ in range(30))]
    texts += [shared[:399], shared[:400], shared[100:501], noise(50) * 30, b"z" * 900, b"z" * 401 + noise(3) + b"z" * 700, b"ab" * 350, b"", b"short"]
    edited = bytearray(shared)
    for _ in range(4):
        edited[draw.randrange(len(edited))] = 33
    return texts + [bytes(edited), shared + shared[:600], texts[0], "äöüß".encode() * 120 + noise(10), "äöüß".encode() * 130]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    check(spark, crafted(seed))


def test_crowded_anchors_take_the_distributed_path(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_STRETCHES", 3)
    check(spark, crafted(3))


def test_small_batches(spark, monkeypatch):
    monkeypatch.setattr(substrings, "ORDERED_BYTES", 3000)
    check(spark, crafted(4))


def test_corpus_order_is_the_suffix_order():
    draw = np.random.default_rng(3)
    for letters in (1, 2, 4):
        bodies = [bytes(draw.integers(97, 97 + letters, int(n), dtype=np.uint8)) for n in draw.integers(0, 400, 5)]
        bodies.append(bodies[0] + bodies[1])
        raw, starts, order = substrings.corpus_order(bodies)
        gap = substrings.PHRASE_GRAM
        suffixes = {int(s) + i: tuple(b[i:]) for s, b in zip(starts, bodies, strict=True) for i in range(len(b))}
        got = [suffixes[i] for i in order.tolist() if i in suffixes]
        assert sorted(order.tolist()) == list(range(sum(len(b) + gap for b in bodies)))
        assert got == sorted(got)


def test_awkward_rows(spark):
    docs = documents(spark).withColumnRenamed("n_chars", "kept")
    rows = docs.select("doc_id", "text").collect()
    want = brute([(r["text"] or "").encode() for r in rows], substrings.LENGTH)
    got = substrings.dedup(docs, fields=("n_removed", "kept_text")).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_bytes"] - r["n_removed"]) for r in got) == sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(w)) for r, w in zip(rows, want, strict=True))


def brute_passages(texts, words):
    """Texts without runs of `words` words that also start elsewhere."""
    at = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", t)] for t in texts]
    run = lambda k, i: tuple(texts[k][a:b] for a, b in at[k][i : i + words])
    runs = Counter(run(k, i) for k in range(len(texts)) for i in range(len(at[k]) - words + 1))
    out = []
    for k, t in enumerate(texts):
        gone = [False] * len(t)
        spans = [(at[k][i][0], at[k][i + words - 1][1]) for i in range(len(at[k]) - words + 1) if runs[run(k, i)] > 1]
        for a, b in spans:
            gone[a:b] = [True] * (b - a)
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_fifty_words_go_however_short(spark, seed):
    draw = random.Random(seed)
    words = lambda n: " ".join("".join(draw.choice("abcdef") for _ in range(draw.randint(1, 6))) for _ in range(n))
    short = words(140).split()
    texts = []
    for n in (49, 50, 51, 60, 49, 51, 75, 120):
        a = draw.randrange(140 - n + 1)
        texts.append(words(30) + draw.choice([" ", "\n"]) + draw.choice([" ", "\n", "  "]).join(short[a : a + n]) + " " + words(draw.randint(0, 40)))
    texts += [" ".join("ab"[k % 2] for k in range(60)), words(55), words(20), "", "x" * 401, "x" * 401 + " y", "w " * 70, "é ü " * 80]
    texts += [texts[9], texts[10], texts[0]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in substrings.dedup_passages(df).collect()}
    want = brute_passages([t.encode() for t in texts], 50)
    assert [got[k] for k in range(len(texts))] == [w.decode() for w in want]


def test_empty(spark):
    assert substrings.dedup_passages(empty(spark)).collect() == []
    assert substrings.dedup(empty(spark)).collect() == []
