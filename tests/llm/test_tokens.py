import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmill.llm import bpe, packing
from tests.llm.fixtures import documents, empty

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_texts(coder, reference):
    draw = random.Random(3)
    texts = ["", "  ", "a" * 3000, "ab" * 900, "ሴé" * 300, " \n\n  \t x", "a\x1cb \x1d\x1d c", "日本語テキスト" * 90, "it's we'll I'M", "\U0001f600" * 120, "1234567890" * 90, None, "<|endoftext|>", "".join(draw.choice("abcdefghijkl") for _ in range(900))]
    for text, (ids, body) in zip(texts, coder.round_trip(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text or "")
        assert body == (text or "").encode()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(coder, reference, texts):
    for text, (ids, body) in zip(texts, coder.round_trip(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert body == text.encode()


def test_digests_and_decode(spark, reference):
    docs = documents(spark)
    want = Counter()
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    got = bpe.digests(docs, RANKS, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == want
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], bytes(r["body"])) for r in back.collect()) == Counter((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())
    assert bpe.digests(empty(spark), RANKS, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcİéÉ.,'s 0\n\x1c\u00a0ßſK"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_words_are_encoded_as_the_tokenizer_does(texts):
    words = packing.Words(open(WORDS, encoding="utf-8").read())
    ids, counts = words.documents([t.encode() for t in texts])
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert counts.tolist() == list(map(len, want))
    assert ids.tolist() == [x for w in want for x in w]


def test_packing(spark):
    docs = documents(spark)
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(r["doc_id"], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.pack(docs, WORDS).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled: dict[int, list] = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(empty(spark), WORDS).collect() == []


def sequential(histogram, capacity):
    """Gaps that best-fit decreasing leaves, one document at a time."""
    gaps: list[int] = []
    for length in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
    return gaps


def placed(blocks, capacity):
    """(documents of each length, filled places of each sequence); every block fills its sequences without a gap."""
    free: Counter = Counter()
    seen: dict[int, list[int]] = {}
    for length, low, n, seq, each, at in sorted(blocks, key=lambda b: b[5]):
        for turn in range(n):
            seen.setdefault(length, []).append(low + turn)
            assert free[seq + turn // each] == at + turn % each * length
            free[seq + turn // each] += length
    assert all(sorted(ranks) == list(range(len(ranks))) for ranks in seen.values())
    assert all(x <= capacity for x in free.values())
    return Counter({k: len(v) for k, v in seen.items()}), free


def test_best_fit_places_all_in_about_as_few_as_sequential_best_fit(spark):
    draw = np.random.default_rng(3)
    cases = [{64: 9, 33: 5, 32: 7, 31: 5, 1: 3}, {1: 2000}, {64: 3}, {33: 40}, {22: 90, 21: 7}, {int(k): int(n) for k, n in zip(draw.integers(1, 65, 40), draw.integers(1, 30, 40), strict=True)}]
    for histogram in cases:
        got = packing.best_fit(spark.createDataFrame(list(histogram.items()), "length long, n long"), 64).collect()
        seen, free = placed([tuple(r) for r in got], 64)
        assert seen == Counter(histogram)
        assert len(free) <= len(sequential(histogram, 64)) + 1
    assert packing.best_fit(spark.createDataFrame([], "length long, n long"), 64).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12), st.dictionaries(st.integers(1, 63), st.integers(1, 20), max_size=12))
def test_a_sweep_leaves_nothing_that_fits_in_its_range(docs, gaps):
    width = 64 // packing.RANGES
    rows = [(packing.DOCS, (k - 1) // width, k, 0, n, 0, 0, 0) for k, n in docs.items()]
    rows += [(packing.GAPS, (k - 1) // width, k, 0, n, 1000 * k, 0, 0) for k, n in gaps.items()]
    tokens = lambda rs, kind: sum(r[2] * r[4] for r in rs if r[0] == kind)
    for at in range(packing.RANGES):
        own = [r for r in rows if r[1] == at]
        out = packing.sweep(own, 64)
        assert tokens(out, packing.DOCS) + tokens(out, packing.BLOCKS) == tokens(own, packing.DOCS)
        assert tokens(out, packing.GAPS) + tokens(out, packing.BLOCKS) == tokens(own, packing.GAPS)
        left = [r for r in out if r[0] == packing.DOCS]
        assert all(r[1] == (at + 1 if at + 1 < packing.RANGES else packing.ASIDE) for r in left)
        assert not any(g[0] == packing.GAPS and g[1] == at and g[2] >= r[2] for r in left for g in out)
    whole = packing.sweep(rows, 64)
    assert sorted(whole) == sorted(r for at in range(packing.RANGES) for r in packing.sweep([r for r in rows if r[1] == at], 64))


def test_clashing_columns_and_a_long_text(spark, reference):
    long = "word über 12 " * 250_000
    df = spark.createDataFrame([(1, "ab", 9, "x"), (2, long, 9, "y"), (3, None, 9, "z")], "doc_id long, text string, n_tokens int, ids string")
    got = bpe.digests(df, RANKS, public_tokenizers.PATTERN)
    assert sorted(got.columns) == ["decoded_sha256", "doc_id", "ids", "ids_sha256", "n_tokens"]
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[1]["ids"] == "x" and by_id[3]["n_tokens"] == 0
    assert by_id[2]["n_tokens"] == len(reference.encode_ordinary(long)) and by_id[2]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
