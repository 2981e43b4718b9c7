"""Language identification by a linear-chain conditional random field over words.

Each word's label is a language.  Its emission scores come from a lexicon (how often
each language's training documents have the word) and from hashed byte n-grams of
the word between boundary marks, of which those that touch a mark are its affixes;
transitions between the labels of neighbouring words are learned too.  Training
sequences join segments of documents of several languages, so the chain learns to
switch.  Forward-backward gives each word's label probabilities; a document's
language is the one with the largest mean over its words with a letter, and that
mean is its score, so every word of a code-switched text counts.

The field is fitted on a bounded sample: PER_LANG documents of each language, in
the order of a hash of their ids, and SEGMENTS runs of SEGMENT words of each, spread
evenly over the text.  Prediction reads whole texts and nothing but texts.

Results in odd cases: a null text, or one without a letter, is 'und' with score 0;
so is every text if nothing can be learned from; null ids count as ''; a row with a
null language or text isn't learned from; repeated rows each get their row; an empty
table gives an empty table; other columns are carried unless they have a result's
name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbers, release, slices

FOLDS = 5
PER_LANG = 400
SEGMENTS = 8
SEGMENT = 24
#: Hashed n-gram features, and the lengths of n-grams.
FEATURE_BITS = 16
NGRAMS = (2, 3, 4, 5)
#: Words that the lexicon keeps, at most; the commonest stay.
LEXICON = 50_000
LENGTH = 32
SEQUENCES = 6000
BATCH = 100
RATE = 0.15
#: Words of a block; blocks are scanned together, then chained.
STEP = 64
REMEMBERED = 600_000
UNDETERMINED = "und"


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text is 0 modulo FOLDS."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == 0


def core(word: bytes) -> bytes:
    """The word in lower case, without what isn't a letter at its ends; empty if it has no letter."""
    text = word.decode("utf-8", "replace").lower()
    if text.isalpha():
        return text.encode()
    start, end = 0, len(text)
    while start < end and not text[start].isalpha():
        start += 1
    while end > start and not text[end - 1].isalpha():
        end -= 1
    return text[start:end].encode()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all words, number of each word's): n-grams of the bytes between boundary marks."""
    lens = np.array([len(w) + 2 for w in words], np.int64)
    flat = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    ends = np.repeat(np.cumsum(lens), lens)
    place = np.arange(len(flat))
    owner = np.repeat(np.arange(len(words)), lens)
    codes, owners = [], []
    code = flat.copy()
    for k in range(1, max(NGRAMS)):
        code = code[: max(len(flat) - k, 0)] * np.uint64(257) + flat[k:]
        if k + 1 in NGRAMS:
            whole = np.flatnonzero(place[: len(code)] + k < ends[: len(code)])
            mixed = (code[whole] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            codes.append(((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
            owners.append(owner[whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(codes)[order], np.bincount(owner, minlength=len(words))


class Field:
    """The weights and what they say about words and chains."""

    def __init__(self, langs: list[str], lexicon: dict[bytes, np.ndarray]):
        self.langs, self.lexicon = langs, lexicon
        n = len(langs)
        self.grams = np.zeros((1 << FEATURE_BITS, n))
        self.lex = np.zeros((n, n))
        self.step = np.zeros((n, n))

    @classmethod
    def of(cls, parts: dict) -> Field:
        """The field with these attributes."""
        field = cls.__new__(cls)
        field.__dict__.update(parts)
        return field

    def lexical(self, words: list[bytes]) -> np.ndarray:
        none = np.zeros(len(self.langs))
        return np.array([self.lexicon.get(w, none) for w in words]).reshape(len(words), len(self.langs))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores of each word (cores; an empty one says nothing)."""
        if not words:
            return np.zeros((0, len(self.langs)))
        grams, counts = features(words)
        starts = np.cumsum(counts) - counts
        out = np.add.reduceat(np.vstack([self.grams[grams], np.zeros((1, len(self.langs)))]), starts, axis=0) / np.sqrt(np.maximum(counts, 1))[:, None]
        out += self.lexical(words) @ self.lex
        out[[not w for w in words]] = 0
        return out


def fit_field(rows: list[tuple[str, list[bytes]]]) -> Field:
    """Fit on (language, words) segments, by Adagrad on the likelihood of joined segments."""
    langs = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(langs)}
    n = len(langs)
    counts: dict[bytes, np.ndarray] = {}
    cored = [(number[lang], [core(w) for w in words]) for lang, words in rows]
    for k, words in cored:
        for w in words:
            if w:
                counts.setdefault(w, np.zeros(n))[k] += 1
    common = sorted((w for w, c in counts.items() if c.sum() > 1), key=lambda w: (-counts[w].sum(), w))[:LEXICON]
    totals = np.maximum(sum(counts.values(), np.zeros(n)), 1)
    share = {w: (counts[w] / totals + 1e-5) for w in common}
    field = Field(langs, {w: np.log(s / s.sum()) + np.log(n) for w, s in share.items()})
    if n < 2:
        return field
    by_lang: list[list[list[bytes]]] = [[w for k, w in cored if k == lang] for lang in range(n)]
    draw = np.random.default_rng(7)
    words: Numbers = Numbers()
    tokens, labels = np.zeros((SEQUENCES, LENGTH), np.int64), np.zeros((SEQUENCES, LENGTH), np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < LENGTH:
            lang = int(draw.integers(n))
            segment = by_lang[lang][int(draw.integers(len(by_lang[lang])))]
            take = segment[: min(len(segment), LENGTH - at, int(draw.integers(4, LENGTH + 1)))]
            tokens[s, at : at + len(take)] = [words[w] for w in take]
            labels[s, at : at + len(take)] = lang
            at += len(take)
    vocabulary = list(words)
    grams, many = features(vocabulary)
    starts = np.cumsum(many) - many
    lexical, blank = field.lexical(vocabulary), np.array([not w for w in vocabulary])
    scale = 1 / np.sqrt(np.maximum(many, 1))
    seen = [np.full_like(w, 1e-6) for w in (field.grams, field.lex, field.step)]
    for at in range(0, SEQUENCES, BATCH):
        own, inverse = np.unique(tokens[at : at + BATCH], return_inverse=True)
        inverse = inverse.reshape(-1, LENGTH)
        gold = labels[at : at + BATCH]
        index = np.concatenate([np.arange(a, a + k) for a, k in zip(starts[own], many[own], strict=True)])
        part, of = grams[index], np.repeat(np.arange(len(own)), many[own])
        score = np.zeros((len(own), n))
        np.add.at(score, of, field.grams[part] * scale[own][of][:, None])
        score += lexical[own] @ field.lex
        score[blank[own]] = 0
        wrong, moves = _gradient(score[inverse], gold, field.step)
        by_word = np.zeros((len(own), n))
        np.add.at(by_word, inverse.ravel(), wrong.reshape(-1, n))
        by_word[blank[own]] = 0
        touched, where = np.unique(part, return_inverse=True)
        by_gram = np.zeros((len(touched), n))
        np.add.at(by_gram, where, by_word[of] * scale[own][of][:, None])
        for weights, past, slot, grad in ((field.grams, seen[0], touched, by_gram), (field.lex, seen[1], slice(None), lexical[own].T @ by_word), (field.step, seen[2], slice(None), moves)):
            grad = grad / len(gold)
            past[slot] += grad**2
            weights[slot] += RATE * grad / np.sqrt(past[slot])
    return field


def _gradient(score: np.ndarray, gold: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood with respect to emissions and transitions, by forward-backward."""
    many, length, n = score.shape
    emit, move = np.exp(score - score.max(2, keepdims=True)), np.exp(step)
    ahead, back = np.zeros((length, many, n)), np.ones((length, many, n))
    held = np.full((many, n), 1 / n)
    for t in range(length):
        held = (held @ move) * emit[:, t]
        held /= held.sum(1, keepdims=True)
        ahead[t] = held
    for t in range(length - 2, -1, -1):
        back[t] = (back[t + 1] * emit[:, t + 1]) @ move.T
        back[t] /= back[t].sum(1, keepdims=True)
    likely = ahead * back
    likely /= likely.sum(2, keepdims=True)
    wrong = -likely.transpose(1, 0, 2)
    np.put_along_axis(wrong, gold[:, :, None], np.take_along_axis(wrong, gold[:, :, None], 2) + 1, 2)
    pair = ahead[:-1][:, :, :, None] * move * (emit.transpose(1, 0, 2)[1:] * back[1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    moves = -pair.sum((0, 1))
    np.add.at(moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    return wrong, moves


def posteriors(score: np.ndarray, lens: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of chains that follow each other in `score`.

    Chains are cut into blocks of STEP words.  Each block's product of transition
    matrices is found for all blocks at once, a scan over a chain's blocks gives what
    enters each from either side, and a second pass within blocks gives each word's
    probabilities: the exact result, in few sequential steps even for long chains.
    """
    n = score.shape[1]
    blocks = -(-lens // STEP)
    chain = np.repeat(np.arange(len(lens)), blocks)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.cumsum(blocks) - blocks
    row = (np.cumsum(lens) - lens)[chain] + nth * STEP
    size = np.minimum(lens[chain] - nth * STEP, STEP)
    emit = np.exp(score - score.max(1, keepdims=True))
    move = np.exp(step - step.max())
    at = np.minimum(row + np.arange(STEP)[:, None], len(score) - 1)
    real = np.arange(STEP)[:, None] < size
    emit = np.where(real[:, :, None], emit[at], 0)
    product = np.broadcast_to(np.eye(n), (len(chain), n, n)).copy()
    for k in range(STEP):
        more = (product @ move) * emit[k][:, None, :]
        more /= np.maximum(more.max((1, 2), keepdims=True), 1e-300)
        product = np.where(real[k][:, None, None], more, product)
    enters, leaves = np.zeros((len(chain), n)), np.ones((len(chain), n))
    order = np.argsort(-blocks, kind="stable")
    alive = np.searchsorted(-blocks[order], -np.arange(1, blocks.max() + 1), "right")
    held = np.full((len(lens), n), 1 / n)
    for k, live in enumerate(alive):
        own = order[:live]
        enters[first[own] + k] = held[own]
        out = np.einsum("bi,bij->bj", held[own], product[first[own] + k])
        held[own] = out / out.sum(1, keepdims=True)
    held = np.ones((len(lens), n))
    for k in range(len(alive) - 1, -1, -1):
        own = order[: alive[k]]
        leaves[first[own] + k] = held[own]
        out = np.einsum("bij,bj->bi", product[first[own] + k], held[own])
        held[own] = out / out.sum(1, keepdims=True)
    ahead = np.zeros((STEP, len(chain), n))
    held = enters
    for k in range(STEP):
        more = (held @ move) * emit[k]
        held = np.where(real[k][:, None], more / np.maximum(more.sum(1, keepdims=True), 1e-300), held)
        ahead[k] = held
    held = leaves
    for k in range(STEP - 1, -1, -1):
        ahead[k] *= held
        more = (held * emit[k]) @ move.T
        held = np.where(real[k][:, None], more / np.maximum(more.sum(1, keepdims=True), 1e-300), held)
    likely = ahead.transpose(1, 0, 2)[real.T]
    return likely / likely.sum(1, keepdims=True)


class Labeller:
    """Labels the words of texts; remembers the scores of words."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.words = Numbers()
        self.scores = np.zeros((0, len(self.field.langs)))
        self.lettered = np.zeros(0, bool)

    def label(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label probabilities of all words, whether each has a letter, words of each text)."""
        if len(self.words) > REMEMBERED:
            self.forget()
        number = self.words.__getitem__
        codes = [np.fromiter(map(number, t.split()), np.int64) for t in texts]
        fresh = [core(w) for w in list(self.words)[len(self.scores) :]]
        if fresh:
            self.scores = np.concatenate([self.scores, self.field.emissions(fresh)])
            self.lettered = np.concatenate([self.lettered, np.array([bool(w) for w in fresh])])
        lens = np.array([len(c) for c in codes], np.int64)
        own = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        likely = np.zeros((len(own), len(self.field.langs)))
        if len(own):
            likely = posteriors(self.scores[own], lens[lens > 0], self.field.step)
        return likely, self.lettered[own], lens


def predict(labeller: Labeller, texts: list[bytes]) -> tuple[list[str], np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Language and score of each text, and the label probabilities of its words."""
    likely, lettered, lens = labeller.label(texts)
    owner = np.repeat(np.arange(len(lens)), lens)
    n = np.bincount(owner[lettered], minlength=len(lens))
    sums = np.zeros((len(lens), likely.shape[1]))
    for k in range(likely.shape[1]):
        sums[:, k] = np.bincount(owner[lettered], likely[lettered, k], len(lens))
    means = sums / np.maximum(n, 1)[:, None]
    best, langs = means.argmax(1), labeller.field.langs
    pred = [langs[b] if k else UNDETERMINED for b, k in zip(best, n, strict=True)]
    return pred, np.where(n > 0, np.clip(means[np.arange(len(lens)), best], 0, 1), 0.0), (likely, lens)


def runs(likely: np.ndarray, lens: np.ndarray, langs: list[str]) -> list[list[dict]]:
    """Runs of words with the same likeliest language: start, end (words) and lang."""
    out = []
    at = 0
    for n in lens.tolist():
        own = likely[at : at + n].argmax(1)
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n] if n else []
        out.append([{"start": a, "end": b, "lang": langs[own[a]]} for a, b in zip(edges, edges[1:], strict=False)])
        at += n
    return out


def sample(labelled: DataFrame, key: str, text: str, lang: str) -> list[tuple[str, list[bytes]]]:
    """Segments of at most PER_LANG documents of each language, at the driver."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row for each language
    if not counts:
        return []
    order = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("sample"))
    place = F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))
    # A hash threshold draws some more than PER_LANG before anything is sorted; what is over goes afterwards.
    share = reduce(lambda e, kv: e.when(F.col(lang) == kv[0], min(1.0, (PER_LANG + 4 * PER_LANG**0.5) / kv[1])), list(counts.items()), F.when(F.lit(False), 0.0))
    drawn = rows.filter(place < share).select(F.col(lang).alias("lang"), order.alias("at"), F.col(text).alias("text"))

    def cut(batches):
        for batch in batches:
            langs, ats, words = [], [], []
            for name, at, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = body.encode("utf-8", "replace").split()
                gap = max(SEGMENT, -(-len(own) // SEGMENTS))
                for k in range(0, len(own), gap):
                    langs.append(name)
                    ats.append(at)
                    words.append([w.decode("utf-8", "replace") for w in own[k : k + SEGMENT]])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ats, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["lang", "at", "words"])

    got = drawn.mapInArrow(cut, "lang string, at long, words array<string>").collect()
    kept: dict[str, set[int]] = {}
    for name, at in sorted({(r["lang"], r["at"]) for r in got}):
        if len(own := kept.setdefault(name, set())) < PER_LANG:
            own.add(at)
    chosen = sorted((r["lang"], r["at"], k, r["words"]) for k, r in enumerate(got) if r["at"] in kept[r["lang"]])
    return [(name, [w.encode() for w in words]) for name, _, _, words in chosen]


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Field | None:
    """The field learned from labelled rows; null where they have nothing to learn from."""
    rows = sample(labelled, key, text, lang)
    return fit_field(rows) if rows else None


RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


def with_language(docs: DataFrame, field: Field | None, text: str = "text", keep_text: bool = False, with_runs: bool = False) -> DataFrame:
    """docs with lang_pred and score, and with `lang_runs` if asked for, in one narrow pass."""
    added = ["lang_pred", "score"] + ["lang_runs"] * with_runs
    kept = [f for f in docs.schema.fields if f.name not in added and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    # Of fixed size: hashed features and at most LEXICON words. Plain data, as broadcasts are pickled by reference to classes.
    held = docs.sparkSession.sparkContext.broadcast(dict(vars(field)) if field else None)

    def run(batches):
        labeller = Labeller(Field.of(held.value)) if held.value else None
        for batch in batches:
            for part in slices(batch, text):
                if labeller:
                    pred, score, (likely, lens) = predict(labeller, [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()])
                else:
                    pred, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                made = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                if with_runs:
                    own = runs(likely, lens, labeller.field.langs) if labeller else [[] for _ in pred]
                    made.append(pa.array(own, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + made, names=names + added)
        del labeller
        release()

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("lang_runs", RUNS)] * with_runs
    return docs.mapInArrow(run, T.StructType(kept + fields))
