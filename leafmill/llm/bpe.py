"""Byte-level BPE by DuckDB recursive queries, one database in memory for each partition.

A task splits its texts with the pretokenizer's pattern and hands each distinct
piece to DuckDB once: rows (piece, byte offset, token, length) join the merge table
on neighbouring tokens, and each step of the recursion contracts the leftmost pair
of least rank of every piece until none is left.  A piece that is itself a token
needs no step.  Decoding is an ordered aggregation of the tokens' bytes.  Pieces
over LONG_PIECE bytes contract every non-overlapping pair of least rank at once
where that can't change the result: a merge whose token takes part in no pair of
lower rank (column `calm`) creates nothing that would have gone first.

Results in odd cases: a null text is the empty text, with no ids; repeated rows
each get their row; long texts and long pieces are encoded whole; an empty table
gives an empty table; other columns are carried unless they have a result's name.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Numbers, release, slices

#: White_Space, which \s means in the tokenizer's own engine; Python's \s also has U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces encoded by one query, and the steps after which it starts anew from its last state.
BATCH = 20_000
STEPS = 24
LONG_PIECE = 400
POSITION_BITS = 28
#: Distinct pieces that a task remembers; beyond it the memory starts anew.
REMEMBERED = 600_000

_PAIRS = """
WITH RECURSIVE step AS (
  SELECT key, tok, len, false AS done, 0 AS n FROM start
  UNION ALL
  (WITH cur AS (SELECT key, tok, len, n FROM step WHERE NOT done AND n < {steps}),
  pairs AS (
    SELECT a.key, a.key >> {bits} AS piece, m.out, m.calm, a.tok = b.tok AS twin, a.len AS alen, b.len AS blen
    FROM cur a JOIN cur b ON b.key = a.key + a.len JOIN merges m ON m.pair = (a.tok << 20 | b.tok)),
  {hit},
  change AS (SELECT key, out, blen, false AS gone FROM hit UNION ALL SELECT key + alen, NULL, NULL, true FROM hit)
  SELECT c.key, COALESCE(h.out, c.tok) AS tok, c.len + COALESCE(h.blen, 0) AS len, w.piece IS NULL AS done, c.n + 1 AS n
  FROM cur c LEFT JOIN change h ON h.key = c.key LEFT JOIN {pieces} w ON w.piece = c.key >> {bits}
  WHERE h.gone IS NOT TRUE)
)
SELECT key, tok, len, done FROM step WHERE done OR n = {steps}
"""
#: Short pieces: place and lengths fit in 9 bits each, so that one minimum finds the pair.
_LEFTMOST = """least AS (SELECT piece, min((out << 27) | ((key & {mask}) << 18) | (alen << 9) | blen) AS v FROM pairs GROUP BY piece),
  hit AS (SELECT piece, (piece << {bits}) | ((v >> 18) & 511) AS key, v >> 27 AS out, (v >> 9) & 511 AS alen, v & 511 AS blen FROM least)"""
_ALL_CALM = """best AS (SELECT piece, min(out) AS out FROM pairs GROUP BY piece),
  least AS (
    SELECT p.*, row_number() OVER (PARTITION BY p.piece ORDER BY p.key) AS rn FROM pairs p JOIN best b ON b.piece = p.piece AND b.out = p.out),
  runs AS (SELECT *, row_number() OVER (PARTITION BY piece, key - rn * alen ORDER BY key) AS place FROM least),
  hit AS (
    SELECT piece, key, out, alen, blen FROM runs
    WHERE CASE WHEN calm THEN NOT twin OR place % 2 = 1 ELSE rn = 1 END)"""
_FIXED = {"bits": POSITION_BITS, "mask": (1 << POSITION_BITS) - 1}
QUERY = {
    name: _PAIRS.format(steps=STEPS, hit=hit.format(**_FIXED), pieces=pieces, **_FIXED)
    for name, hit, pieces in (("leftmost", _LEFTMOST, "hit"), ("all", _ALL_CALM, "(SELECT DISTINCT piece FROM hit)"))
}
DECODE = "SELECT seq, unhex(string_agg(v.digits, '' ORDER BY t.pos)) AS body FROM tokens t JOIN vocab v ON v.tok = t.tok GROUP BY seq"


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """The vocabulary of a rank file, in file order."""
    with open(path, "rb") as f:
        return [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, f)]


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(pair, out, calm): each split of a token into two tokens."""
    rows = [(left, right, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None]
    early = {x for left, right, rank in rows for x in (left, right) if x > rank}
    return pa.table({"pair": pa.array([a << 20 | b for a, b, _ in rows], pa.int64()), "out": pa.array([r for *_, r in rows], pa.int64()), "calm": pa.array([r not in early for *_, r in rows])})


class Coder:
    """Encodes and decodes in one DuckDB database, on one thread and in bounded memory."""

    def __init__(self, vocabulary: list[tuple[bytes, int]], pattern: str):
        self.ranks = dict(vocabulary)
        self.pattern = regex.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))
        self.bytes = np.array([self.ranks.get(bytes([k]), -1) for k in range(256)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB"})
        self.db.register("merges_", merge_table(self.ranks))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_")
        self.db.register("vocab_", pa.table({"tok": pa.array([r for _, r in vocabulary], pa.int64()), "digits": [t.hex() for t, _ in vocabulary]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_")
        self.forget()

    def close(self) -> None:
        self.db.close()

    def forget(self) -> None:
        self.pieces = Numbers()
        self.known: list[str] = []
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.decoded: list[bytes] = []

    def contract(self, pieces: list[bytes], query: str) -> list[np.ndarray]:
        """The ids of each piece."""
        flat, lens = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)
        start = {"key": np.repeat(np.arange(len(pieces)), lens) << POSITION_BITS | (np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)), "tok": self.bytes[flat], "len": np.ones(len(flat), np.int64)}
        keys, toks = [], []
        while len(start["key"]):
            self.db.register("start", pa.table(start))
            got = self.db.execute(query).fetchnumpy()
            self.db.unregister("start")
            done = np.asarray(got["done"])
            keys.append(np.asarray(got["key"])[done])
            toks.append(np.asarray(got["tok"])[done])
            start = {k: np.asarray(got[k])[~done] for k in start}
        key, tok = np.concatenate(keys), np.concatenate(toks)
        order = np.argsort(key)
        return np.split(tok[order].astype(np.uint32), np.flatnonzero(np.diff(key[order] >> POSITION_BITS)) + 1)

    def decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        out = [b""] * len(sequences)
        lens = np.array([len(s) for s in sequences], np.int64)
        if lens.sum():
            self.db.register("tokens", pa.table({"seq": np.repeat(np.arange(len(lens)), lens), "pos": np.arange(lens.sum()), "tok": np.concatenate(sequences).astype(np.int64)}))
            got = self.db.execute(DECODE).fetchnumpy()
            self.db.unregister("tokens")
            for k, body in zip(got["seq"].tolist(), got["body"], strict=True):
                out[k] = bytes(body)
        return out

    def learn(self) -> None:
        """Encode and decode the pieces that have been numbered since the last call."""
        fresh = [p.encode("utf-8", "surrogatepass") for p in list(self.pieces)[len(self.decoded) :]]
        made: list[np.ndarray] = [None] * len(fresh)  # type: ignore[list-item]
        todo: dict[str, list[int]] = {"leftmost": [], "all": []}
        for k, piece in enumerate(fresh):
            if (rank := self.ranks.get(piece)) is not None:
                made[k] = np.array([rank], np.uint32)
            else:
                todo["all" if len(piece) > LONG_PIECE else "leftmost"].append(k)
        for query, places in todo.items():
            for at in range(0, len(places), BATCH):
                part = places[at : at + BATCH]
                for k, ids in zip(part, self.contract([fresh[k] for k in part], QUERY[query]), strict=True):
                    made[k] = ids
        for at in range(0, len(made), BATCH):
            self.decoded += self.decode(made[at : at + BATCH])
        counts = np.array([len(x) for x in made], np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, *made]) if made else self.ids

    def round_trip(self, texts: list[str | None]) -> list[tuple[np.ndarray, bytes]]:
        """(ids, decoded bytes) of each text."""
        if len(self.pieces) > REMEMBERED:
            self.forget()
        number, find = self.pieces.__getitem__, self.pattern.findall
        codes = [np.fromiter(map(number, find(text or "")), np.int64) for text in texts]
        if len(self.pieces) > len(self.decoded):
            self.learn()
        out = []
        for own in codes:
            counts = self.counts[own]
            ends = np.cumsum(counts)
            at = np.repeat(self.starts[own] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
            out.append((self.ids[at], b"".join(map(self.decoded.__getitem__, own.tolist()))))
        return out


def _round_trips(df: DataFrame, text: str, path: str, pattern: str, fields: list[T.StructField], kinds: list[pa.DataType], finish) -> DataFrame:
    names_made = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name != text and f.name not in names_made]
    names = [f.name for f in kept]
    vocabulary = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # a vocabulary: fixed size

    def run(batches):
        coder = Coder(vocabulary.value, pattern)
        for batch in batches:
            for part in slices(batch, text):
                rows = [finish(ids, body) for ids, body in coder.round_trip(part.column(text).to_pylist())]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + made, names=names + names_made)
        coder.close()
        del coder
        release()

    return df.mapInArrow(run, T.StructType(kept + fields))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The text column becomes `ids`."""
    field = T.StructField("ids", T.ArrayType(T.IntegerType()))
    return _round_trips(df, text, path, pattern, [field], [pa.list_(pa.int32())], lambda ids, _: (ids.astype(np.int32),))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The ids column becomes `body`, the bytes its tokens stand for; a null list is empty bytes."""
    kept = [f for f in df.schema.fields if f.name not in (ids, "body")]
    names = [f.name for f in kept]
    vocabulary = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        coder = Coder(vocabulary.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bodies = coder.decode([np.array(x or [], np.uint32) for x in part.column(ids).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(bodies, pa.binary())], names=[*names, "body"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("body", T.BinaryType())]))


def digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The text column becomes n_tokens and the SHA-256 of its ids and of what they decode to."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def finish(ids: np.ndarray, body: bytes) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(body).hexdigest()

    return _round_trips(df, text, path, pattern, fields, [pa.int64(), pa.string(), pa.string()], finish)
