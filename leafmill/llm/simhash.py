"""SimHash near-duplicates: fingerprints, BK-trees of shards, connected components.

A shard holds the fingerprints that agree in some of the blocks into which the
64 bits are cut: with b blocks, two fingerprints at RADIUS bits or fewer agree in
at least b - RADIUS of them, so every link shows in the shard of such a choice of
blocks.  Each shard is a BK-tree (children keyed by their integer Hamming distance
to the parent); its tree goes to every slice of the shard's queries, which follow
only the edges within the radius.  That is the broadcast of a shard's tree: it
moves by shuffle, to the tasks that ask, and no tree reaches the driver.  A shard
over TREE_ROWS is cut into slices, and each pair of slices is a unit of its own,
so a hot shard spreads over tasks.

A unit returns a spanning forest of its links, never the pairs, and the forests
join into components by alternating stars.

Results in odd cases: a null or wordless text has fingerprint 0, which links like
any other; a text under SHINGLE words is one shingle; repeated rows each get their
row; where every doc_id of a group is null its component_id is null; an empty
table gives an empty table; other columns are carried unless they have a result's
name.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.staging import drop_scratch, scratch

from .common import free_name, release, slices

SHINGLE = 4
SEED = 42
RADIUS = 4
LEAST_BLOCKS = 6
#: Fingerprints in a mean shard; blocks are added until it is met.
SHARD_ROWS = 64
#: Fingerprints of a tree; larger shards are cut into slices.
TREE_ROWS = 1 << 15
#: (query, node) pairs that a task holds at once.
FRONTIER = 1 << 20
BLOCK = 1 << 17


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The uint64 fingerprint of each text."""
    ones = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    held: list[int] = []
    runs: list[tuple[int, int]] = []

    def flush() -> None:
        if not held:
            return
        bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum([0] + [n for _, n in runs[:-1]])
        np.add.at(ones, [d for d, _ in runs], np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        held.clear()
        runs.clear()

    for d, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) < shingle:
            shingles = [b" ".join(words)]
        else:
            shingles = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
        totals[d] = len(shingles)
        for at in range(0, len(shingles), BLOCK):
            part = shingles[at : at + BLOCK]
            held.extend(map(xxhash.xxh64_intdigest, part, repeat(SEED)))
            runs.append((d, len(part)))
            if len(held) >= BLOCK:
                flush()
    flush()
    return (2 * ones > totals[:, None]) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))


def with_fingerprint(docs: DataFrame, text: str = "text", keep_text: bool = True, shingle: int = SHINGLE) -> DataFrame:
    """docs with `fp`, the fingerprint as a long, in one narrow pass."""
    docs = docs.drop("fp")
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                made = fingerprints([x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()], shingle)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(made.view(np.int64))], names=names + ["fp"])
        release()

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("fp", T.LongType())]))


def _masks(blocks: int) -> list[int]:
    """A mask for each choice of blocks - RADIUS blocks, as signed longs."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    whole = (sum(c) for c in combinations(parts, blocks - RADIUS))
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def blocks_for(n: int) -> int:
    """Blocks for n distinct fingerprints; more blocks cost copies and make shards smaller, and the links stay the same."""
    blocks = LEAST_BLOCKS
    while n >> (64 * (blocks - RADIUS) // blocks) > SHARD_ROWS and blocks < 12:
        blocks += 1
    return blocks


class Forest:
    """BK-trees over rows that are sorted by unit; the first tree row of each unit is its root."""

    def __init__(self, unit: np.ndarray, fp: np.ndarray, in_tree: np.ndarray):
        self.fp = fp
        rows = np.flatnonzero(in_tree)
        first = np.ones(len(rows), bool)
        first[1:] = unit[rows[1:]] != unit[rows[:-1]]
        self.root_unit, self.root = unit[rows[first]], rows[first]
        left = rows[~first]
        at = self.root[np.cumsum(first) - 1][~first]
        keys, nodes = [], []
        while len(left):
            apart = np.bitwise_count(fp[left] ^ fp[at]).astype(np.int64)
            slot = at * 65 + apart
            uniq, taken, where = np.unique(slot, return_index=True, return_inverse=True)
            keys.append(uniq)
            nodes.append(left[taken])
            stay = np.ones(len(left), bool)
            stay[taken] = False
            at = left[taken][where][stay]
            left = left[stay]
            same = fp[left] != fp[at]  # a repeat of its node needs no place
            left, at = left[same], at[same]
        keys_, nodes_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nodes))
        order = np.argsort(keys_, kind="stable")
        self.keys, self.nodes = keys_[order], nodes_[order]

    def search(self, query: np.ndarray, unit: np.ndarray):
        """(query row, node row) arrays of all pairs within RADIUS, level by level of the trees."""
        at = np.searchsorted(self.root_unit, unit)
        has = at < len(self.root)
        has[has] = self.root_unit[at[has]] == unit[has]
        query, node = query[has], self.root[at[has]]
        while len(query):
            apart = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            near = (apart <= RADIUS) & (query != node)
            yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(apart - RADIUS, 0), "left")
            high = np.searchsorted(self.keys, node * 65 + np.minimum(apart + RADIUS, 64), "right")
            many = high - low
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            query, node = np.repeat(query, many), self.nodes[np.repeat(low, many) + step]


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge labels over links in place; a label is the least row of its component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped


def unit_forest(unit: np.ndarray, fp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (a, b) of the links in each unit; rows come sorted by unit. side: 1 tree, 2 query, 3 both."""
    order = np.lexsort((fp, unit))
    unit, fp, side = unit[order], fp[order], side[order]
    forest = Forest(unit, fp, (side & 1) > 0)
    label = np.arange(len(fp))
    queries = np.flatnonzero(side & 2)
    size = np.bincount(np.searchsorted(forest.root_unit, unit[(side & 1) > 0]), minlength=len(forest.root)) if len(forest.root) else np.zeros(1, np.int64)
    cost = size[np.minimum(np.searchsorted(forest.root_unit, unit[queries]), len(size) - 1)]
    ends = np.cumsum(cost)
    start = 0
    while start < len(queries):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + FRONTIER, "right")))
        for q, n in forest.search(queries[start:stop], unit[queries[start:stop]]):
            settle(label, q, n)
        start = stop
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def _forests(batches):
    """unit_forest over partitions sorted by unit, in runs of whole units."""
    held, rows = [], 0
    edges = lambda t: pa.RecordBatch.from_pydict(dict(zip("ab", (pa.array(x.view(np.int64)) for x in unit_forest(*t)), strict=True)))
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().astype(np.int64)))
        rows += batch.num_rows
        if rows >= FRONTIER >> 2:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0] != whole[0][-1], False)) if whole[0][0] == whole[0][-1] else int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1
            if cut:
                yield edges([x[:cut] for x in whole])
            held, rows = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
    if held:
        yield edges([np.concatenate(x) for x in zip(*held, strict=True)])
    held.clear()
    release()


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) with a <> b: links that join all distinct fingerprints (column fp) within RADIUS, as forests."""
    masks = _masks(blocks_for(distinct.count()))
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > TREE_ROWS)
    hot = scratch(sizes.select("shard", F.ceil(F.col("n") / TREE_ROWS).cast("int").alias("cuts")), "hot")
    units = rows.select(F.col("shard").alias("unit"), "fp", F.lit(3).alias("side"))
    if not hot.isEmpty():
        cut = rows.join(hot, "shard", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("slice", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("cuts")).cast("int"))
        met = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
        low, high = F.least("slice", "other"), F.greatest("slice", "other")
        # The lower slice is the tree of a unit and the higher one asks; a slice on its own does both.
        side = F.when(F.col("slice") == F.col("other"), 3).when(F.col("slice") < F.col("other"), 1).otherwise(2)
        units = met.select(F.when(F.col("cuts") == 1, F.col("shard")).otherwise(F.xxhash64("shard", low, high)).alias("unit"), "fp", side.alias("side"))
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_forests, "a long, b long").distinct()


def stars(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(a, b): each node of a connected component but the least, with the least; alternating large and small stars."""
    edges = scratch(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        made = scratch(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), name)
        now = made.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        drop_scratch(edges)
        edges = made
        if now == mark or not now[0]:
            return edges
        mark = now


def components(marked: DataFrame, key: str) -> DataFrame:
    """(fp, first_id, component, root): each distinct fingerprint with its least key, the least key that links reach, and
    the least fingerprint that they reach. Only root tells classes apart: keys may be null or shared by classes."""
    reps = marked.groupBy("fp").agg(F.min(key).alias("first_id"))
    pairs = stars(links(reps.select("fp")))
    linked = pairs.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    known = scratch(linked.join(reps, "fp"), "known")
    lowest = known.groupBy("root").agg(F.min("first_id").alias("lowest"))
    labels = known.join(lowest, "root").select("fp", "lowest", "root")
    joined = reps.join(labels, "fp", "left")
    return joined.select("fp", "first_id", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("lowest")).alias("component"), F.coalesce("root", "fp").alias("root"))


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of every row."""
    marked = scratch(with_fingerprint(docs.select(key, text), text, keep_text=False), "fingerprints")
    # Written first, so that the join's sides come straight from shuffles and a hot fingerprint's partition can split.
    found = scratch(components(marked, key).select("fp", F.col("component").alias("component_id")), "components")
    return marked.join(found, "fp").select(key, "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays: the one with the least (key, fingerprint)."""
    marked = scratch(with_fingerprint(docs.select(key, text), text, keep_text=False), "fingerprints")
    found = scratch(components(marked, key).select("fp", "root"), "components")
    stay = marked.join(found, "fp").groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.col("fp").alias("f"))).alias("s"))
    k, f = free_name(docs, "k_"), free_name(docs, "f_")
    stay = stay.select(F.col("s.k").alias(k), F.col("s.f").alias(f))
    met = with_fingerprint(docs, text).join(stay, F.col(key).eqNullSafe(F.col(k)) & (F.col("fp") == F.col(f)))
    return met.dropDuplicates([k, f]).select(*docs.columns)
