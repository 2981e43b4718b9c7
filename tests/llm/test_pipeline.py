"""Each stage on its predecessor's output, and run() as a whole, against a brute-force version."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from leafmill.llm import langid, quality, substrings
from tests.llm import test_quality, test_substrings
from tests.llm.fixtures import SCHEMA, documents, empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def bag(rows):
    return Counter(str(tuple(r)) for r in rows)


def plain_quality(rows):
    """Exact counts; quartiles of buckets counted in plain dictionaries."""
    counted = []
    for r in rows:
        n_words, chars, symbols, dup, repeat = test_quality.brute(r["text"])
        failed = n_words < 20 or 100 * repeat > 30 * n_words
        values = {"word_length": chars / max(n_words, 1), "symbols": symbols / max(n_words, 1), "dup_lines": dup / ((r["text"] or "").count("\n") + 1)}
        counted.append((r, failed, values))
    bucket = lambda v: math.ceil(math.log(v) / math.log(quality.GAMMA)) if v > 0 else None
    value = lambda b: 0.0 if b is None else 2 * quality.GAMMA**b / (quality.GAMMA + 1)

    def quartiles(group, name):
        held = sorted((bucket(v[name]) for v in group), key=lambda b: (b is not None, b or 0))
        at = lambda q: value(held[math.ceil(q * len(held)) - 1])
        return at(0.25), at(0.75)

    passed = [(r, v) for r, failed, v in counted if not failed]
    kept = []
    for r, failed, v in counted:
        if failed:
            continue
        key = (r["lang"] or "", r["source"] or "")
        own = [w for x, w in passed if (x["lang"] or "", x["source"] or "") == key]
        by_lang = [w for x, w in passed if (x["lang"] or "") == key[0]]
        group = own if len(own) >= quality.MIN_ROWS else by_lang if len(by_lang) >= quality.MIN_ROWS else [w for _, w in passed]
        inside = True
        for name, (_, _, reach, least, scale, below) in quality.METRICS.items():
            q1, q3 = quartiles(group, name)
            spread = max(q3 - q1, least * scale)
            inside &= (q1 - reach * spread if below else -1.0) <= v[name] <= q3 + reach * spread
        if inside:
            kept.append(r)
    return kept


def plain_language(rows, field):
    kept = []
    for r in rows:
        words = [langid.core(w) for w in (r["text"] or "").encode().split()]
        if not any(words):
            continue
        score = np.exp(np.vstack([field.emissions([w]) for w in words]))
        move = np.exp(field.step)
        ahead, back = [], [np.ones(len(field.langs))]
        held = np.full(len(field.langs), 1 / len(field.langs))
        for s in score:
            held = (held @ move) * s
            held /= held.sum()
            ahead.append(held)
        for s in score[:0:-1]:
            back.append(move @ (s * back[-1]))
            back[-1] /= back[-1].sum()
        likely = np.array(ahead) * np.array(back[::-1])
        likely /= likely.sum(1, keepdims=True)
        if likely[[bool(w) for w in words]].mean(0).max() >= corpus_pipeline.MIN_SCORE:
            kept.append(r)
    return kept


def plain_near_duplicates(rows):
    """Classes of texts by five-word shingles at a Jaccard similarity of 4/5, by comparing all pairs."""
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = [shingles(r["text"]) for r in rows]
    label = list(range(len(rows)))
    for k in range(len(rows)):
        for j in range(k):
            if 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]):
                label = [label[j] if x == label[k] else x for x in label]
    best = {}
    for k, c in enumerate(label):
        t = xxhash.xxh64_intdigest((rows[k]["text"] or "").encode(), 42)
        order = (rows[k]["doc_id"] is None, rows[k]["doc_id"] or 0, t - (1 << 64) if t >> 63 else t)
        if c not in best or order < best[c][0]:
            best[c] = (order, rows[k])
    return [r for _, r in best.values()]


def plain_substrings(rows):
    texts = test_substrings.brute_passages([(r["text"] or "").encode() for r in rows], substrings.PASSAGE)
    return [(r["doc_id"], t := b.decode("utf-8", "ignore"), r["lang"], r["source"], len(t)) for r, b in zip(rows, texts, strict=True)]


def plain_pieces(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            out[(doc_id, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    return out


def test_stages_match_brute_force(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    def check(name, want):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = stages[name](spark, df, str(tmp_path))
        assert got.columns == COLUMNS
        got = got.collect()
        assert bag(got) == bag(want)
        return got

    rows = check("quality rules", plain_quality(rows))
    field = langid.fit(spark.createDataFrame(rows, SCHEMA).filter(~langid.held_out(F.col("doc_id"))))
    rows = check("language ID", plain_language(rows, field))
    rows = check("SimHash near-dedup", plain_near_duplicates(rows))
    assert 50 < len(rows) < 75
    rows = check("suffix-array dedup", plain_substrings(rows))
    want = plain_pieces(rows)
    last = stages["best-fit packing"](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    for made in (last, corpus_pipeline.run(spark, str(tmp_path)).collect()):
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in made) == want


def test_empty_documents(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_each_stage_on_empty_documents(spark, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty(spark), str(tmp_path))
        assert got.collect() == [] and (name == "best-fit packing" or got.columns == COLUMNS)
