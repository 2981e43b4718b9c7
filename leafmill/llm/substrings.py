"""Exact substring deduplication by prefix-free parsing.

Every byte goes that a LENGTH-byte string covers which also starts somewhere else.
The corpus has no one suffix array; its parse is what is distributed:

1. Parse.  A rolling hash marks triggers, the minima among REACH positions on
   either side, so equal strings have equal triggers.  A trigger's anchor, the bytes
   from REACH before it to AHEAD after it, lies whole in each window of which it is
   the first trigger.  Only windows whose anchors all occur twice can occur twice.
2. Phrases.  The windows with the same first anchor start in one stretch of text;
   the phrase of the stretch is the bytes that they cover.  Equal phrases are joined
   by two 64-bit hashes, and all windows in a repeated phrase are repeated.
3. Suffixes.  What is left are stretches in which a repeat begins or ends.  They meet
   those of equal anchor (of each repeated phrase one copy stands for all), and
   prefix-free parsing orders the suffixes there: suffix array of the dictionary of
   phrases, suffix array of the parse, and both combined into the order of the text.
   Neighbours in that order are compared byte by byte.

Windows without an anchor are phrases of their own.
Anchors that more than HOT_STRETCHES stretches share take no one task: their windows
are joined by their hashes instead, with partial counts before the shuffle.

Texts that are equal are processed once: each is a repeat of the other.

Results in odd cases: a null text is the empty text; texts under LENGTH bytes stay as
they are; repeated rows are repeats of each other; null or repeated ids do no harm, as
rows meet by their text; an empty table gives an empty table; other columns are
carried unless they have a result's name.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.staging import scratch

from .common import free_name, release, slices, text_as_bytes

LENGTH = 400
REACH = 32
AHEAD = 64
#: Bytes of the rolling hash that makes triggers.
GRAM = 12
HOT_STRETCHES = 4096
#: Bytes of texts parsed at once, and of stretches whose suffixes are ordered at once.
PARSED_BYTES = 1 << 20
ORDERED_BYTES = 1 << 20
#: About what a stretch holds, and what a partition of stretches should.
STRETCH_BYTES, PARTITION_BYTES = 600, 4 << 20
#: In the suffix stage, a phrase ends where the hash of PHRASE_GRAM bytes is 0 modulo PHRASE_MOD.
PHRASE_GRAM, PHRASE_MOD = 6, 24
KEYS = ["k1", "k2"]

_random = np.random.default_rng(20240229)
_VALUES = _random.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, 1 << 16)
        up, down = (np.full(size, b, np.uint64) for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[which]


class Rolling:
    """Hashes of any substrings of a byte array, from prefix sums; equal strings have equal hashes wherever they are."""

    def __init__(self, flat: np.ndarray, which: int = 0):
        up, self.down = _powers(which, len(flat) + 1)
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_VALUES[which][flat] * up[: len(flat)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x ^= x >> np.uint64(32)
        return (x * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all substrings of n bytes."""
        last = max(0, len(self.sums) - n)
        return (self.sums[n : n + last] - self.sums[:last]) * self.down[:last]


def _sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    span, low = 1, a
    while span * 2 <= n:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    return np.minimum(low[: len(low) - (n - span)], low[n - span :]) if n > span else low


class Parsed:
    """Texts laid end to end, with triggers, first-anchor stretches and windows without an anchor."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        self.length = length
        self.lens = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.rolling = Rolling(self.flat)
        self.t, self.doc = self._triggers()
        #: Windows [low, high] with the trigger as their first.
        before = np.concatenate([[-(1 << 40)], self.t[:-1]])
        before[np.diff(self.doc, prepend=-1) != 0] = -(1 << 40)
        self.low = np.maximum.reduce([before - REACH + 1, self.t + AHEAD - length, self.starts[self.doc]])
        self.high = np.minimum(self.t - REACH, self.ends[self.doc] - length)

    def _triggers(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.flat) < 2 * REACH + GRAM:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = self.rolling.grams(GRAM)
        mixed = ((grams ^ grams >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
        side = _sliding_min(mixed, REACH)  # side[i]: the least of i .. i + REACH - 1
        at = np.arange(REACH, len(mixed) - REACH)
        at = at[(mixed[at] <= side[at - REACH]) & (mixed[at] <= side[at + 1])]
        doc = np.searchsorted(self.ends, at, "right")
        inside = (at - REACH >= self.starts[doc]) & (at + AHEAD <= self.ends[doc])
        return at[inside], doc[inside]

    def anchors(self) -> np.ndarray:
        return self.rolling.of(self.t - REACH, self.t + AHEAD)

    def orphans(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, text) of windows that no stretch has."""
        edges = np.zeros(len(self.flat) + 1, np.int32)
        own = self.lens >= self.length
        np.add.at(edges, self.starts[own], 1)
        np.add.at(edges, self.ends[own] - self.length + 1, -1)
        some = self.low <= self.high
        np.add.at(edges, self.low[some], -1)
        np.add.at(edges, self.high[some] + 1, 1)
        at = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        return at, np.searchsorted(self.ends, at, "right")


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).to_pylist()


def _take(batch: pa.RecordBatch, doc: np.ndarray) -> dict[str, pa.Array]:
    return {k: batch.column(k).take(pa.array(doc)) for k in KEYS}


def _sliced(df: DataFrame, kernel, schema: str, *options) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", PARSED_BYTES):
                yield pa.RecordBatch.from_pydict(kernel(part, *options))
        _POWERS.clear()
        release()

    return df.mapInArrow(run, schema)


def _anchor_rows(part: pa.RecordBatch, length: int) -> dict[str, pa.Array]:
    """Anchors (place: the trigger) and windows without one (place: -1 - window)."""
    p = Parsed(_binary(part, "text"), length)
    orphan, doc = p.orphans()
    docs = np.concatenate([p.doc, doc])
    hashes = np.concatenate([p.anchors(), p.rolling.of(orphan, orphan + length)])
    place = np.concatenate([p.t - p.starts[p.doc], -1 - (orphan - p.starts[doc])])
    return {"h": pa.array(hashes), **_take(part, docs), "place": pa.array(place)}


def _phrase_rows(part: pa.RecordBatch, length: int) -> dict[str, pa.Array]:
    """The phrase of each stretch of windows whose anchors all are repeated: its hashes, windows low .. high and first anchor."""
    p = Parsed(_binary(part, "text"), length)
    marks = part.column("places")
    owner = np.repeat(np.arange(part.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False))
    place = marks.flatten().to_numpy(zero_copy_only=False)
    repeated = np.isin(p.t, (place + p.starts[owner])[place >= 0])
    # The next trigger that isn't repeated bounds the windows that may be.
    following = np.full(len(p.t) + 1, 1 << 40)
    nearest = np.minimum.accumulate(np.where(repeated, 1 << 40, p.t)[::-1])[::-1]
    following[: len(p.t)] = nearest
    same = p.doc[np.minimum(np.searchsorted(p.t, following[1:]), max(len(p.t) - 1, 0))] == p.doc if len(p.t) else np.zeros(0, bool)
    limit = np.where(same & (following[1:] < 1 << 40), following[1:] + AHEAD - length - 1, 1 << 40)
    high = np.minimum(p.high, limit)
    own = repeated & (p.low <= high)
    orphan = (-1 - place + p.starts[owner])[place < 0]
    low, high = np.concatenate([p.low[own], orphan]), np.concatenate([high[own], orphan])
    docs = np.concatenate([p.doc[own], owner[place < 0]])
    anchor = pa.array(np.concatenate([p.anchors()[own], np.zeros(len(orphan), np.int64)]), mask=np.concatenate([np.zeros(own.sum(), bool), np.ones(len(orphan), bool)]))
    return {
        "e1": pa.array(p.rolling.of(low, high + length)), "e2": pa.array(Rolling(p.flat, 1).of(low, high + length)),
        **_take(part, docs), "low": pa.array(low - p.starts[docs]), "high": pa.array(high - p.starts[docs]), "anchor": anchor,
    }


def _listed(part: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row, fields) of the structs in column `ranges`."""
    ranges = part.column("ranges")
    owner = np.repeat(np.arange(part.num_rows), ranges.value_lengths().to_numpy(zero_copy_only=False))
    flat = ranges.flatten()
    return owner, {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}


def _stretch_rows(part: pa.RecordBatch, length: int) -> dict[str, pa.Array]:
    texts = _binary(part, "text")
    owner, r = _listed(part)
    body = [texts[d][a : b + length] for d, a, b in zip(owner.tolist(), r["low"].tolist(), r["high"].tolist(), strict=True)]
    return {"anchor": pa.array(r["anchor"]), **_take(part, owner), "low": pa.array(r["low"]), "wanted": pa.array(r["wanted"]), "body": pa.array(body, pa.binary())}


def _window_rows(part: pa.RecordBatch, length: int) -> dict[str, pa.Array]:
    p = Parsed(_binary(part, "text"), length)
    owner, r = _listed(part)
    many = r["high"] - r["low"] + 1
    at = np.repeat(r["low"] - np.cumsum(many) + many, many) + np.arange(many.sum())
    docs = np.repeat(owner, many)
    where = at + p.starts[docs]
    return {"e1": pa.array(p.rolling.of(where, where + length)), "e2": pa.array(Rolling(p.flat, 1).of(where, where + length)), **_take(part, docs), "low": pa.array(at), "wanted": pa.array(np.repeat(r["wanted"], many))}


def _ranks(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of pairs."""
    uniq, inverse = np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)
    return inverse.astype(np.int64), len(uniq)


def _suffix_ranks(symbols: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes that stop at `end` (exclusive), by prefix doubling; equal suffixes have equal ranks."""
    rank, classes = _ranks(symbols.astype(np.int64), np.zeros(len(symbols), np.int64))
    at = np.arange(len(symbols))
    step, longest = 1, int((end - at).max(initial=0))
    while step < longest and classes < len(symbols):
        there = at + step
        second = np.where(there < end, rank[np.minimum(there, len(symbols) - 1)] + 1, 0)
        rank, classes = _ranks(rank, second)
        step *= 2
    return rank


def corpus_order(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat bytes, start of each body, places of all suffixes in order) by prefix-free parsing.

    Each body is followed by PHRASE_GRAM end marks.  Phrases run from trigger to trigger
    and overlap by PHRASE_GRAM symbols, so no phrase suffix over that length is a prefix
    of another, and a suffix of the text sorts by the phrase suffix it starts with and
    then by the rank of the parse after it.
    """
    gap = PHRASE_GRAM
    lens = np.array([len(b) + gap for b in bodies], np.int64)
    starts = np.cumsum(lens) - lens
    flat = np.zeros(int(lens.sum()), np.int64)
    raw = np.frombuffer((b"\0" * gap).join(bodies) + b"\0" * gap, np.uint8)
    flat[:] = raw
    flat += 1
    for k in range(gap):
        flat[starts + lens - 1 - k] = 0
    cut = np.zeros(len(flat), bool)
    grams = Rolling(raw).grams(gap)
    cut[: len(grams)] = ((grams ^ grams >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(PHRASE_MOD) == 0
    for k in range(2 * gap):  # no trigger may hold an end mark
        cut[np.maximum(starts + lens - 1 - k, starts)] = False
    cut[starts] = True
    first = np.flatnonzero(cut)
    body_of = np.searchsorted(starts, first, "right") - 1
    last = np.append(first[1:], len(flat))
    new_body = np.append(body_of[1:] != body_of[:-1], True)
    end = np.where(new_body, last, last + gap)
    # Dictionary: each distinct phrase once.
    symbols = flat.astype("<u2").tobytes()
    number: dict[bytes, int] = {}
    phrase = np.fromiter((number.setdefault(symbols[2 * a : 2 * b], len(number)) for a, b in zip(first.tolist(), end.tolist(), strict=True)), np.int64, len(first))
    words = list(number)
    sizes = np.array([len(w) // 2 for w in words], np.int64)
    word_start = np.cumsum(sizes) - sizes
    dictionary = np.frombuffer(b"".join(words), "<u2").astype(np.int64)
    alpha = _suffix_ranks(dictionary, np.repeat(word_start + sizes, sizes))
    # Parse: phrases by the rank of their whole text, and ranks of its suffixes.
    parse = _suffix_ranks(alpha[word_start[phrase]], np.repeat(np.append(np.flatnonzero(new_body) + 1, 0)[:-1], np.diff(np.append(-1, np.flatnonzero(new_body)))))
    after = np.where(new_body, 0, np.append(parse[1:], 0) + 1)
    # Combine: every place of the text by its phrase suffix and the parse after its phrase.
    size = last - first
    owner = np.repeat(np.arange(len(first)), size)
    offset = np.arange(len(flat)) - first[owner]
    order = np.lexsort((after[owner], alpha[word_start[phrase[owner]] + offset]))
    return raw, starts, order


def repeated_windows(bodies: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each body, whether each of its windows of `length` bytes also starts elsewhere in the bodies."""
    many = np.array([max(0, len(b) - length + 1) for b in bodies], np.int64)
    if not many.any():
        return [np.zeros(0, bool) for _ in bodies]
    raw, starts, order = corpus_order(bodies)
    starting = np.zeros(len(raw), bool)
    at = np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())
    starting[at] = True
    order = order[starting[order]]
    found = np.zeros(len(raw), bool)
    windows = np.lib.stride_tricks.sliding_window_view(raw, length)
    wide = np.lib.stride_tricks.sliding_window_view(raw, 8)
    for k in range(0, len(order) - 1, 8192):
        a, b = order[k : k + 8193][:-1], order[k + 1 : k + 8193]
        close = np.all(wide[a + length - 8] == wide[b + length - 8], axis=1)  # cheap, rules out most
        a, b = a[close], b[close]
        same = np.all(windows[a] == windows[b], axis=1)
        found[a[same]] = found[b[same]] = True
    return [found[s : s + n] for s, n in zip(starts.tolist(), many.tolist(), strict=True)]


def _flag_runs(batches, length: int):
    """Runs of repeated windows in the wanted stretches; rows come sorted by anchor and whole anchors are ordered together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = batch.column("body").to_pylist()
        rows: list[tuple[int, int, int]] = []
        wanted, low = batch.column("wanted").to_pylist(), batch.column("low").to_pylist()
        for k, flags in enumerate(repeated_windows(bodies, length)):
            if wanted[k] and flags.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                rows += [(k, low[k] + int(a), low[k] + int(b) - 1) for a, b in edge.reshape(-1, 2)]
        at = np.array(rows, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_pydict({**_take(batch, at[:, 0]), "low": pa.array(at[:, 1]), "high": pa.array(at[:, 2])})

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for incoming in batches:
        for batch in slices(incoming, "body", ORDERED_BYTES // 2):
            held.append(batch)
            size += batch.column("body").nbytes
            if size >= ORDERED_BYTES:
                whole = joined()
                anchor = whole.column("anchor").to_numpy()
                cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
                if cut:
                    yield emit(whole.slice(0, cut))
                held = [whole.slice(cut)]
                size = held[0].column("body").nbytes
    if held and sum(b.num_rows for b in held):
        yield emit(joined())
    _POWERS.clear()
    release()


def _spans(low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes that windows low .. high cover."""
    order = np.argsort(low, kind="stable")
    start, end = low[order], np.maximum.accumulate(high[order] + length)
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[fresh].tolist(), end[np.append(fresh[1:], len(end)) - 1].tolist(), strict=True))


def text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(20240229), text, F.octet_length(text)).alias("k2")]


def removed_spans(docs: DataFrame, text: str, kernel_fields: list[T.StructField], finish, length: int = LENGTH) -> DataFrame:
    """(k1, k2, fields) of each distinct text of `length` bytes or more; finish(text, spans) gives the fields.

    An anchor lies whole in a window: length is over REACH + AHEAD by as much as triggers are apart, or windows lack one.
    """
    if length <= 2 * REACH + AHEAD:
        raise ValueError(f"windows of {length} bytes are too short for anchors of {REACH + AHEAD}")
    body = text_as_bytes(F.col(text))
    long = docs.select(*text_key(body), body.alias("text")).filter(F.octet_length("text") >= length)
    texts = long.groupBy(*KEYS).agg(F.count("*").alias("copies"), F.max("text").alias("text"))
    # What occurs twice is written before it is joined: both sides of the join then come
    # straight from shuffles, and Spark splits the partition of a hot hash.
    # 1. Anchors that occur twice.
    anchors = _sliced(texts, _anchor_rows, "h long, k1 long, k2 long, place long", length)
    twice = scratch(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "twice")
    places = anchors.join(twice, "h", "left_semi").groupBy(*KEYS).agg(F.collect_list("place").alias("places"))
    # 2. Phrases that occur twice.
    phrases = scratch(_sliced(texts.join(places, KEYS), _phrase_rows, "e1 long, e2 long, k1 long, k2 long, low long, high long, anchor long", length), "phrases")
    spot = F.struct("k1", "k2", "low")
    again = scratch(phrases.groupBy("e1", "e2").agg(F.count("*").alias("n"), F.min(spot).alias("first")).filter("n > 1").select("e1", "e2", "first"), "again")
    known = scratch(phrases.join(again, ["e1", "e2"], "left").select(*KEYS, "low", "high", "anchor", F.col("first").isNotNull().alias("repeated"), F.coalesce(F.col("first") == spot, F.lit(False)).alias("stands")), "known")
    # 3. Stretches in which a repeat begins or ends, and one copy of each repeated phrase with such an anchor.
    open_ = known.filter(~F.col("repeated") & F.col("anchor").isNotNull())
    asked = scratch(open_.groupBy("anchor").agg(F.count("*").alias("asks")).select("anchor"), "asked")
    stands = known.filter(F.col("stands") & F.col("anchor").isNotNull()).join(asked, "anchor", "left_semi")
    live = open_.select(*KEYS, "low", "high", "anchor", F.lit(True).alias("wanted")).unionByName(stands.select(*KEYS, "low", "high", "anchor", F.lit(False).alias("wanted")))
    crowd = scratch(live.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "crowd")
    sized = scratch(live.join(crowd, "anchor"), "live")  # alone at its anchor: repeated nowhere
    ranges = F.collect_list(F.struct("low", "high", "anchor", "wanted")).alias("ranges")
    cool, hot = (sized.filter(c).groupBy(*KEYS).agg(ranges) for c in (F.col("n") <= HOT_STRETCHES, F.col("n") > HOT_STRETCHES))
    stretches = _sliced(texts.join(cool, KEYS), _stretch_rows, "anchor long, k1 long, k2 long, low long, wanted boolean, body binary", length)
    # Ordering suffixes costs far more than moving them: partitions are of a few megabytes.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sized.count() * STRETCH_BYTES // PARTITION_BYTES))
    found = stretches.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: _flag_runs(batches, length), "k1 long, k2 long, low long, high long")
    windows = _sliced(texts.join(hot, KEYS), _window_rows, "e1 long, e2 long, k1 long, k2 long, low long, wanted boolean", length)
    common = windows.groupBy("e1", "e2").agg(F.count("*").alias("n")).filter("n > 1").select("e1", "e2")
    hot_found = windows.filter("wanted").join(common, ["e1", "e2"], "left_semi").select(*KEYS, "low", F.col("low").alias("high"))
    covers = known.filter("repeated").select(*KEYS, "low", "high").unionByName(found).unionByName(hot_found)
    listed = covers.groupBy(*KEYS).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    def cut(part: pa.RecordBatch) -> dict[str, pa.Array]:
        owner, r = _listed(part)
        edges = np.searchsorted(owner, np.arange(part.num_rows + 1))
        rows = []
        for k, (body, copies) in enumerate(zip(_binary(part, "text"), part.column("copies").to_pylist(), strict=True)):
            a, b = edges[k], edges[k + 1]
            spans = [(0, len(body))] if copies > 1 else _spans(r["low"][a:b], r["high"][a:b], length) if b > a else []
            rows.append(finish(body, spans))
        made = {f.name: [row[k] for row in rows] for k, f in enumerate(kernel_fields)}
        return {**{k: part.column(k) for k in KEYS}, **{f.name: pa.array(made[f.name], _ARROW[f.name]) for f in kernel_fields}}

    schema = T.StructType([T.StructField(k, T.LongType()) for k in KEYS] + kernel_fields)
    return _sliced(texts.join(listed, KEYS, "left").withColumn("ranges", F.coalesce("ranges", F.expr("cast(array() as array<struct<low:bigint,high:bigint>>)"))), cut, schema)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = {"n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "kept_text": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
_FIELDS = {"n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "kept": T.BinaryType(), "kept_text": T.StringType(), "spans": SPANS}


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def dedup(docs: DataFrame, text: str = "text", fields: tuple[str, ...] = ("n_removed", "spans", "kept")) -> DataFrame:
    """docs without the text column, with n_bytes and the fields: n_removed, n_spans,
    kept_sha256, spans, kept (bytes) and kept_text (without characters of which a cut left a part)."""
    made = {
        "n_removed": lambda t, s: sum(b - a for a, b in s), "n_spans": lambda t, s: len(s), "kept_sha256": lambda t, s: hashlib.sha256(kept_bytes(t, s)).hexdigest(),
        "kept": kept_bytes, "kept_text": lambda t, s: kept_bytes(t, s).decode("utf-8", "ignore"), "spans": lambda t, s: [{"start": a, "end": b} for a, b in s],
    }
    whole = {"n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.sha2(F.col("body_"), 256), "kept": F.col("body_"), "kept_text": F.col("body_").cast("string"), "spans": F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")}
    found = removed_spans(docs, text, [T.StructField(f, _FIELDS[f]) for f in fields], lambda t, s: [made[f](t, s) for f in fields])
    carried = [c for c in docs.columns if c not in (text, "n_bytes", *fields)]
    body = text_as_bytes(F.col(text))
    # The bodies of long texts come with their result; only short ones travel with their row.
    rows = docs.select(*[F.col(c).alias(f"c_{k}") for k, c in enumerate(carried)], F.octet_length(body).cast("long").alias("n_bytes"), *text_key(body), F.when(F.octet_length(body) < LENGTH, body).alias("body_"))
    met = rows.join(found, KEYS, "left")
    short = F.col("n_bytes") < LENGTH
    return met.select(*[F.col(f"c_{k}").alias(c) for k, c in enumerate(carried)], "n_bytes", *[F.when(short, whole[f]).otherwise(F.col(f)).alias(f) for f in fields])


#: Bytes that stand for a word, and words of a passage's window.
CODE, PASSAGE = 4, 50


def _coded(texts: list[bytes]) -> list[bytes]:
    """Each text's words as 32 bits of their hashes, end to end; white space doesn't show."""
    return [np.fromiter(map(xxhash.xxh32_intdigest, t.split()), "<u4").tobytes() for t in texts]


def _word_spans(text: bytes, coded: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bytes from the first to the last word of each span of codes."""
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", text)]
    whole = [(-(-a // CODE), b // CODE) for a, b in coded]
    return [(words[a][0], words[b - 1][1]) for a, b in whole if a < b]


def dedup_passages(docs: DataFrame, text: str = "text", words: int = PASSAGE) -> DataFrame:
    """docs with their text less each run of `words` words that also starts elsewhere, however short the words are and
    whatever white space lies between them; a character of which a cut left a part goes. A null text is the empty text.

    Runs of words are found as strings are, in texts of which each word is a code of CODE bytes. Windows of 50 words are
    told apart by 1,600 bits: two that differ in one word alone are taken for equal once in 2**32.
    """
    body, code, held = text_as_bytes(F.col(text)), free_name(docs, "codes_"), free_name(docs, "spans_")
    names = docs.columns

    def code_rows(batches):
        for batch in batches:
            for part in slices(batch, text):
                codes = pa.array(_coded([x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, codes], names=[*part.schema.names, code])
        release()

    coded = lambda df: df.mapInArrow(code_rows, T.StructType([*df.schema.fields, T.StructField(code, T.BinaryType())]))
    listed = lambda t, s: [[{"start": a, "end": b} for a, b in s]]
    # Only texts with a repeat, and only their spans, are kept.
    found = removed_spans(coded(docs.select(text)).select(code), code, [T.StructField("spans", SPANS)], listed, words * CODE).filter("size(spans) > 0")
    found = scratch(found, "passage-spans")
    keys = [free_name(docs, k) for k in ("k1_", "k2_")]
    keyed = coded(docs).select(*names, *[c.alias(k) for c, k in zip(text_key(F.col(code)), keys, strict=True)])
    met = keyed.join(found.toDF(*keys, held), keys, "left").select(*names, held)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, text):
                bodies, spans = (part.column(c).to_pylist() for c in (text, held))
                made = [kept_bytes(raw := (t or "").encode("utf-8", "replace"), _word_spans(raw, [(s["start"], s["end"]) for s in own])).decode("utf-8", "ignore") if own else t or "" for t, own in zip(bodies, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if c == text else part.column(c) for c in names], names=names)
        release()

    return met.mapInArrow(cut, docs.schema)
