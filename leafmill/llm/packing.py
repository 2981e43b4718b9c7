"""Bulk-synchronous best-fit packing of tokenised documents into sequences of CAPACITY tokens.

Documents and gaps (the free places of open sequences) are kept range-sorted by size and
run-length encoded: a row is a run of documents of one length with neighbouring ranks,
or of gaps of one size in neighbouring sequences.  A round is one shuffle and one sweep:

1. Documents and gaps of a range of sizes meet in a task, RANGES ranges side by side.
2. The sweep matches each run of documents, the longest first, to its successor, the
   smallest gap of the range that holds it.  Where several ask for the same gaps, the
   order of size and rank decides who gets them.
3. The gaps shrink and move to the range of their new size; documents that found none
   ask in the range above in the next round.  Longer documents so reach every range
   before shorter ones do.

RANGES rounds make a pass, in which every document may ask in every range; they are one
Spark job.  Between passes the driver looks at one row of sums: it ends when all is
placed, repeats while a pass placed anything, and else opens as many sequences as what
is left needs at least, for the longest documents of all.  The sweeps yield blocks, each
a range of ranks of one length that goes to a range of sequences; a document finds its
block by its length and rank, in a join whose keys hold SPAN ranks at most.

The rank of a document among those of its length is its place in its input partition
plus the documents of that length in the partitions before: a range sort by counting,
which no frequent length can crowd into a task.

Results in odd cases: a null or empty text is the end token alone; repeated rows are
packed each; nothing is dropped; an empty table gives an empty table; extra columns are
not carried.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from leafmill.staging import scratch

from .common import Numbers, release, slices

CAPACITY = 2048
END = 0
#: Distinct words that a task remembers; beyond it the memory starts anew.
REMEMBERED = 600_000
#: Words encoded in one call of the tokenizer, and texts of a call.
TOGETHER = 500
CALL = 40
#: What the vocabulary adds to the last token of a word.
WORD_END = "</w>"
#: Ranges of sizes that are swept side by side, and rounds of a pass.
RANGES = 2
#: Ranks of one length that a key of the final join holds.
SPAN = 1 << 20
DOCS, GAPS, BLOCKS = 0, 1, 2
#: Where runs wait that meet nothing in this pass.
ASIDE = -1
STATE = "kind int, at int, size long, first long, n long, seq long, each long, offset long"


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Words:
    """Ids of texts by a tokenizer that drops white space: each distinct word is encoded once.

    Words are runs between ASCII white space in the text with A-Z lower-cased; such a
    tokenizer encodes them independently.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith(WORD_END) for k in range(self.tokenizer.get_vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.words = Numbers({b"": 0})
        self.ids = np.array([END], np.uint32)
        self.starts, self.counts = np.array([0]), np.array([1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for at in range(0, len(texts), CALL) for e in self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's).

        A word of letters is one word to the tokenizer too, so that such words go together
        and the tokens that end a word part them; a group whose number of ends differs
        from its words, and every other word, is encoded word by word.
        """
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        odd = [k for k, w in enumerate(words) if not w.isalpha()]
        counts, parts = np.zeros(len(words), np.int64), []
        order = []
        groups = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        for group, ids in zip(groups, self.encode([" ".join([words[k] for k in g]) for g in groups]), strict=True):
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(group):
                counts[group] = np.diff(last, prepend=-1)
                parts.append(ids)
                order.append(group)
            else:
                odd += group
        for k, ids in zip(odd, self.encode([words[k] for k in odd]), strict=True):
            counts[k] = len(ids)
            parts.append(ids)
            order.append([k])
        flat, place = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.fromiter((k for g in order for k in g), np.int64, len(words))
        starts = np.zeros(len(words), np.int64)
        starts[place] = np.cumsum(counts[place]) - counts[place]
        return flat[_runs(starts, counts)], counts

    def learn(self) -> None:
        fresh = [w.decode() for w in list(self.words)[len(self.counts) :]]
        # A full stop or comma after letters is a word of its own to the tokenizer: the letters are encoded without it.
        stems = Numbers({"": 0})
        pairs = np.array([(stems[w[:-1]], stems[w[-1]]) if w[-1] in ".," and w[:-1].isalpha() else (stems[w], 0) for w in fresh], np.int64).reshape(-1)
        flat, many = self.encode_words(list(stems)[1:])
        many = np.concatenate([[0], many])
        taken = _runs((np.cumsum(many) - many)[pairs], many[pairs])
        counts = many[pairs].reshape(-1, 2).sum(1)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, flat[taken]])

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with END after it, and their numbers."""
        if len(self.words) > REMEMBERED:
            self.forget()
        number = self.words.__getitem__
        codes, sizes = [], []
        for text in texts:
            own = np.fromiter(map(number, text.lower().split()), np.int64)
            codes += [own, np.zeros(1, np.int64)]
            sizes.append(len(own) + 1)
        if len(self.words) > len(self.counts):
            self.learn()
        own = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        counts = self.counts[own]
        ends = np.cumsum(counts)
        at = _runs(self.starts[own], counts)
        last = np.cumsum(np.array(sizes, np.int64)) - 1
        return self.ids[at], np.diff(np.concatenate([[0], ends[last]])) if len(ends) else np.zeros(0, np.int64)


def pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, place): the pieces of each document; place counts those of its length in its partition."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: fixed size
    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        words, part = Words(tokenizer.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, text):
                ids, counts = words.documents([x or b"" for x in rows.column(text).cast(pa.binary()).to_pylist()])
                many = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), many)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(counts[owner] - start, capacity)
                at = (np.cumsum(counts) - counts)[owner] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                groups = np.flatnonzero(np.diff(length[order], prepend=-1))
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(length)) - np.repeat(groups, np.diff(np.append(groups, len(length)))) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(key).take(pa.array(owner)), *map(pa.array, (piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(owner), part, np.int32), place))],
                    names=[key, "piece", "start", "length", "ids_crc32", "part", "place"],
                )
        del words
        release()

    return docs.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part int, place long")


def sweep(rows: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """One round over runs (STATE): what the runs become; the documents and gaps of a range come together."""
    width = -(-capacity // RANGES)
    out: list[tuple] = []
    for at, group in groupby(sorted(rows, key=lambda r: (r[1], r)), key=lambda r: r[1]):
        own = list(group)
        if at == ASIDE:
            out += own
            continue
        sizes: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = {}

        def shrink(size: int, seq: int, n: int, at: int = at, sizes: list[int] = sizes, open_: dict = open_) -> None:
            """Gaps of this size: kept if they belong to the range, else on their way to theirs."""
            if size <= 0 or n <= 0:
                return
            if (size - 1) // width != at:
                out.append((GAPS, (size - 1) // width, size, 0, n, seq, 0, 0))
                return
            if size not in open_:
                insort(sizes, size)
                open_[size] = []
            insort(open_[size], (seq, n))

        for r in own:
            if r[0] == GAPS:
                shrink(r[2], r[5], r[4])
        for _, _, length, low, n, *_ in sorted((r for r in own if r[0] == DOCS), key=lambda r: (-r[2], r[3])):
            while n and (k := bisect_left(sizes, length)) < len(sizes):
                size = sizes[k]
                seq, many = open_[size].pop(0)
                if not open_[size]:
                    del open_[size], sizes[k]
                each = size // length
                used = min(many, -(-n // each))
                placed = min(n, used * each)
                out.append((BLOCKS, ASIDE, length, low, placed, seq, each, capacity - size))
                whole, rest = divmod(placed, each)
                shrink(size - each * length, seq, whole)
                shrink(size - rest * length, seq + whole, 1 if rest else 0)
                shrink(size, seq + used, many - used)
                low, n = low + placed, n - placed
            if n:
                out.append((DOCS, at + 1 if at + 1 < RANGES else ASIDE, length, low, n, 0, 0, 0))
        out += [(GAPS, at, size, 0, n, seq, 0, 0) for size in sizes for seq, n in open_[size]]
    return out


def _round(state: DataFrame, capacity: int) -> DataFrame:
    """One shuffle of all runs to the range where they meet, and its sweep."""
    names = [f.name for f in state.schema.fields]

    def run(batches):
        # The runs of a range: bounded by its sizes and by how often gaps were split, not by documents.
        rows = [r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(len(names))), strict=True)]
        made = sweep(rows, capacity)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], pa.int32() if k < 2 else pa.int64()) for k in range(len(names))], names=names)

    return state.repartition("at").mapInArrow(run, STATE)


def _opened(state: DataFrame, n: int, first: int, capacity: int) -> DataFrame:
    """state with new sequences from `first` on for its n longest documents, which open one each."""
    before = Window.orderBy(F.desc("size"), "first").rowsBetween(Window.unboundedPreceding, -1)  # over the runs left, a few for each length
    docs = state.filter(F.col("kind") == DOCS).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    taken = F.least(F.col("n"), F.greatest(F.lit(0), F.lit(n) - F.col("before")))
    row = lambda kind, size, low, many, seq, each: F.struct(F.lit(kind).alias("kind"), F.lit(ASIDE).alias("at"), size.alias("size"), low.alias("first"), many.alias("n"), seq.alias("seq"), F.lit(each).cast("long").alias("each"), F.lit(0).cast("long").alias("offset"))
    zero, seq = F.lit(0).cast("long"), F.col("before") + first
    rows = F.array(row(BLOCKS, F.col("size"), F.col("first"), F.col("taken"), seq, 1), row(GAPS, capacity - F.col("size"), zero, F.col("taken"), seq, 0), row(DOCS, F.col("size"), F.col("first") + F.col("taken"), F.col("n") - F.col("taken"), zero, 0))
    made = docs.withColumn("taken", taken).select(F.explode(F.filter(rows, lambda r: (r["n"] > 0) & (r["size"] > 0))).alias("r")).select("r.*")
    return state.filter(F.col("kind") != DOCS).unionByName(made)


def best_fit(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Blocks (length, low, n, seq, each, offset) that place all documents of (length, n), ranks running from 0 in each length."""
    zero = F.lit(0).cast("long")
    state = scratch(lengths.select(F.lit(DOCS).alias("kind"), F.lit(ASIDE).alias("at"), F.col("length").alias("size"), zero.alias("first"), F.col("n"), zero.alias("seq"), zero.alias("each"), zero.alias("offset")), "runs")
    width, sequences, before = -(-capacity // RANGES), 0, None
    while True:
        docs = F.col("kind") == DOCS
        left, tokens, large = state.agg(F.sum(F.when(docs, F.col("n"))), F.sum(F.when(docs, F.col("n") * F.col("size"))), F.sum(F.when(docs & (F.col("size") * 2 > capacity), F.col("n")))).first()
        if not left:
            return state.filter(F.col("kind") == BLOCKS).select(F.col("size").alias("length"), F.col("first").alias("low"), "n", "seq", "each", "offset")
        if before in (None, left):  # nothing was placed: no gap holds what is left
            more = min(left, max(large or 0, -(-tokens // capacity)))
            state, sequences = _opened(state, more, sequences, capacity), sequences + more
        before = left
        # Blocks are done with: they stay aside and out of the rounds.
        live = state.filter(F.col("kind") != BLOCKS).withColumn("at", F.floor((F.col("size") - 1) / width).cast("int"))
        for _ in range(RANGES):
            live = _round(live, capacity)
        state = scratch(state.filter(F.col("kind") == BLOCKS).unionByName(live), "runs")


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of a document with its sequence_id and its offset there."""
    cut = scratch(pieces(docs, tokenizer_path, key, text, capacity), "pieces")
    counts = scratch(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    blocks = best_fit(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    spread = blocks.select("length", "low", "n", "seq", "each", F.col("offset").alias("at"), F.explode(F.sequence(F.floor(F.col("low") / SPAN), F.floor((F.col("low") + F.col("n") - 1) / SPAN))).alias("span"))
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("place")).withColumn("span", F.floor(F.col("rank") / SPAN))
    turn = F.col("rank") - F.col("low")
    met = ranked.join(spread, ["length", "span"]).filter((turn >= 0) & (turn < F.col("n")))
    return met.select(
        key, "piece", "start", "length", "ids_crc32", (F.col("seq") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + (turn % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
