"""Language of documents by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from streamloom.llm.textkeys import _BASE, _power_tables, binary_parts, mix, slices

#: Documents of each language that the model learns from, at most: those with the smallest hash of their text.
TRAIN_DOCS = 150
#: Characters of each that it learns from, at most, and parts of a longer text that these are drawn from, evenly over the whole.
TRAIN_CHARS, TRAIN_PARTS = 20_000, 40
#: Words of a sequence, and words around it that it is read with; longer texts are runs of sequences.
STEPS, AROUND = 32, 8
#: Odds that are computed at a time.
ODDS = 1 << 21
#: Rows of the weight tables: lexicon, each affix length, character trigrams.
LEXICON, AFFIX, TRIGRAMS = 1 << 17, 1 << 14, 1 << 16
AFFIXES = 3
EPOCHS, BATCH, RATE, DECAY = 4, 256, 0.3, 1e-4
#: Share of training sequences that go on in another language.
SWITCHED = 0.3
NONE = "und"

_U = np.uint64
_ROWS = LEXICON + 2 * AFFIXES * AFFIX + TRIGRAMS
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: np.ndarray  # _ROWS x labels, 1.2 MB for each
    moves: np.ndarray  # labels x labels
    starts: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, trigram, owner, bounds) of the words of documents in lower-case UTF-8.

    A word is a run of letters. whole holds its rows of the lexicon and affix
    tables (-1 for an affix longer than the word), trigram the rows of all
    trigrams and owner their words; bounds parts the words by document.
    """
    low = int(offsets[0])
    body, at = data[low : int(offsets[-1])], offsets - low
    n = len(body)
    if not n:
        return np.zeros((0, 1 + 2 * AFFIXES), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    letter = _LETTER[body]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (edge[:-1] | ~before))
    ends = np.flatnonzero(letter & (edge[1:] | ~after)) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((body.astype(_U) + _U(1)) * up[:n], out=sums[1:])

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(_U) * _U(_BASE))

    size = ends - starts
    whole = np.full((len(starts), 1 + 2 * AFFIXES), -1, np.int64)
    whole[:, 0] = (run(starts, ends) % _U(LEXICON)).astype(np.int64)
    for k in range(1, AFFIXES + 1):
        has = size >= k
        whole[has, 2 * k - 1] = LEXICON + 2 * (k - 1) * AFFIX + (run(starts[has], starts[has] + k) % _U(AFFIX)).astype(np.int64)
        whole[has, 2 * k] = LEXICON + (2 * k - 1) * AFFIX + (run(ends[has] - k, ends[has]) % _U(AFFIX)).astype(np.int64)
    counts = np.maximum(size - 2, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.arange(len(owner)) + np.repeat(starts - np.cumsum(counts) + counts, counts)
    code = (body[first].astype(_U) << _U(16)) | (body[first + 1].astype(_U) << _U(8)) | body[first + 2]
    trigram = LEXICON + 2 * AFFIXES * AFFIX + (mix(code) % _U(TRIGRAMS)).astype(np.int64)
    return whole, trigram, owner, np.searchsorted(starts, at)


def emissions(weights: np.ndarray, whole: np.ndarray, trigram: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each word's score for each label: the sum of its features' weights."""
    out = np.zeros((len(whole), weights.shape[1]))
    for k in range(whole.shape[1]):
        out += weights[whole[:, k]] * (whole[:, k] >= 0)[:, None]
    for label in range(weights.shape[1]):
        out[:, label] += np.bincount(owner, weights[trigram, label], len(whole))
    return out


def sequences(bounds: np.ndarray, around: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each sequence of up to STEPS words of one document, and of it with the words around."""
    counts = np.diff(bounds)
    parts = -(-counts // STEPS)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, end = np.repeat(bounds[:-1], parts), np.repeat(bounds[1:], parts)
    first = start + nth * STEPS
    last = np.minimum(first + STEPS, end)
    wide = np.maximum(first - around, start)
    return first, last - first, wide, np.minimum(last + around, end) - wide


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded scores (sequence, step, label): each word's label odds, and the expected moves."""
    n, steps, _ = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(moves - moves.max())
    here = np.arange(steps) < lengths[:, None]
    forward, backward = np.empty_like(local), np.ones_like(local)
    forward[:, 0] = np.exp(starts - starts.max()) * local[:, 0]
    forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        now = (forward[:, t - 1] @ step) * local[:, t]
        now /= now.sum(axis=1, keepdims=True)
        forward[:, t] = np.where(here[:, t, None], now, forward[:, t - 1])
    expected = np.zeros_like(moves)
    for t in range(steps - 2, -1, -1):
        ahead = backward[:, t + 1] * local[:, t + 1]
        pairs = forward[:, t, :, None] * step * ahead[:, None, :]
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        expected += (pairs * here[:, t + 1, None, None]).sum(axis=0)
        now = ahead @ step.T
        now /= now.sum(axis=1, keepdims=True)
        backward[:, t] = np.where(here[:, t + 1, None], now, 1.0)
    out = forward * backward
    return out / out.sum(axis=2, keepdims=True), expected


def padded(rows: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """rows of words as (sequence, step, ...), the last word repeated to the end."""
    at = first[:, None] + np.minimum(np.arange(lengths.max()), lengths[:, None] - 1)
    return rows[at]


def gradient(weights: np.ndarray, moves: np.ndarray, starts: np.ndarray, whole: np.ndarray, tri: np.ndarray, tri_owner: np.ndarray, gold: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The gradient of the mean log likelihood of sequences of these lengths: (rows, of weights' rows, of moves, of starts).

    Only rows of features that occur are there. gold has each word's label.
    """
    size, n = weights.shape[1], len(lens)
    begin = np.cumsum(lens) - lens
    odds, expected = posteriors(padded(emissions(weights, whole, tri, tri_owner), begin, lens), lens, moves, starts)
    truth = np.eye(size)[gold]
    miss = (truth - odds[np.arange(odds.shape[1]) < lens[:, None]]) / n
    owner, k = np.nonzero(whole >= 0)
    rows, inverse = np.unique(np.concatenate([whole[owner, k], tri]), return_inverse=True)
    of = np.concatenate([owner, tri_owner])
    own = np.stack([np.bincount(inverse, miss[of, label], len(rows)) for label in range(size)], axis=1)
    inner = np.ones(len(gold), bool)
    inner[begin] = False
    pairs = np.zeros((size, size))
    np.add.at(pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    return rows, own, (pairs - expected) / n, (truth[begin] - odds[:, 0]).mean(axis=0)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Learns weights, moves and starts by stochastic gradient ascent on the likelihood.

    A step touches the rows of its own features alone; the two tables of weights
    have _ROWS rows of a 32-bit number for each label. Every word of a text bears its text's language; part of the sequences go on
    with the words of another text, so that moves between languages are learned.
    """
    labels = sorted(set(langs))
    size = len(labels)
    data, offsets = binary_parts(pa.array([t.lower() for t in texts], pa.large_string()))
    parts, at = [], 0
    bounds = [np.zeros(1, np.int64)]
    for a, b in slices(offsets):
        whole, trigram, owner, own = features(data, offsets[a : b + 1])
        parts.append((whole, trigram, owner + at))
        bounds.append(own[1:] + at)
        at += len(whole)
    whole, trigram, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc_bounds = np.concatenate(bounds)
    gold = np.repeat([labels.index(x) for x in langs], np.diff(doc_bounds))
    first, lengths, _, _ = sequences(doc_bounds)
    tri_bounds = np.searchsorted(owner, np.arange(len(whole) + 1))

    rng = np.random.default_rng(7)
    weights, squares = np.zeros((_ROWS, size), np.float32), np.full((_ROWS, size), 1e-6, np.float32)
    moves, starts = np.zeros((size, size)), np.zeros(size)
    moves_g, starts_g = np.full((size, size), 1e-6), np.full(size, 1e-6)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(first)), max(1, len(first) // BATCH)):
            # the words of each sequence, some of them followed by another's
            words, lens = [], []
            for s in batch:
                own = np.arange(first[s], first[s] + lengths[s])
                if rng.random() < SWITCHED and len(own) > 1:
                    other = rng.integers(len(first))
                    cut = rng.integers(1, len(own))
                    own = np.concatenate([own[:cut], np.arange(first[other], first[other] + min(lengths[other], len(own) - cut))])
                words.append(own)
                lens.append(len(own))
            ids, lens = np.concatenate(words), np.array(lens)
            counts = tri_bounds[ids + 1] - tri_bounds[ids]
            tri_owner = np.repeat(np.arange(len(ids)), counts)
            tri = trigram[np.arange(len(tri_owner)) + np.repeat(tri_bounds[ids] - np.cumsum(counts) + counts, counts)]
            rows, own, of_moves, of_starts = gradient(weights, moves, starts, whole[ids], tri, tri_owner, gold[ids], lens)
            own -= DECAY * weights[rows] * (own != 0)
            squares[rows] += own * own
            weights[rows] += RATE * own / np.sqrt(squares[rows])
            for value, g, sq in ((moves, of_moves, moves_g), (starts, of_starts, starts_g)):
                sq += g * g
                value += RATE * g / np.sqrt(sq)
    return Model(labels, weights, moves, starts)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """The label of the largest mean odds over all words of each text, those odds, and the mean of each word's largest odds.

    Of labels of equal odds the first in order is taken.
    """
    kept = [t.lower() if t is not None and any(c.isalpha() for c in t) else "" for t in texts]
    langs, scores, certain = [NONE] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if not model.labels:
        return langs, scores, certain
    data, offsets = binary_parts(pa.array(kept, pa.large_string()))
    for a, b in slices(offsets):
        whole, trigram, owner, bounds = features(data, offsets[a : b + 1])
        first, lengths, wide, widths = sequences(bounds, AROUND)
        if not len(first):
            continue
        parts, step = [], max(1, ODDS // (STEPS + 2 * AROUND) // len(model.labels))
        for s in range(0, len(first), step):
            part = slice(s, s + step)
            low, high = wide[s], int((wide + widths)[part][-1])
            tri = slice(*np.searchsorted(owner, [low, high]))
            scored = emissions(model.weights, whole[low:high], trigram[tri], owner[tri] - low)
            odds, _ = posteriors(padded(scored, wide[part] - low, widths[part]), widths[part], model.moves, model.starts)
            at = wide[part, None] + np.arange(odds.shape[1])
            own = (at >= first[part, None]) & (at < (first + lengths)[part, None])
            parts.append(np.concatenate([(odds * own[:, :, None]).sum(axis=1), (odds.max(axis=2) * own).sum(axis=1)[:, None]], axis=1))
        sums = np.concatenate(parts)
        # sums of each document's sequences, in order
        of = np.searchsorted(bounds, first, "right") - 1
        docs, starts = np.unique(of, return_index=True)
        means = np.add.reduceat(sums, starts, axis=0) / np.diff(bounds)[docs][:, None]
        for d, mean in zip(docs, means, strict=True):
            langs[a + d] = model.labels[int(mean[:-1].argmax())]
            scores[a + d], certain[a + d] = float(min(1.0, mean[:-1].max())), float(min(1.0, mean[-1]))
    return langs, scores, certain


def drawn(text: Column) -> Column:
    """A text of up to TRAIN_CHARS characters whole, else TRAIN_PARTS parts of it, evenly spread, as lines."""
    size, each = F.length(text).cast("long"), TRAIN_CHARS // TRAIN_PARTS
    parts = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_PARTS - 1)), lambda k: F.substring(text, (F.floor((size - each) * k / (TRAIN_PARTS - 1)) + 1).cast("int"), F.lit(each)))
    return F.when(size <= TRAIN_CHARS, text).otherwise(F.array_join(parts, "\n"))


def training_rows(documents: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """(text, lang) that may be learned from, at most `most` different texts of each language.

    Those with the smallest hash are taken; copies of a text are one. Only
    languages and hashes are shuffled; the chosen texts, a bounded number for a
    language, are read by them.
    """
    may = documents.where("NOT held_out AND doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("lang", F.xxhash64("text").alias("_hash"), "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    chosen = may.select("lang", "_hash").distinct().withColumn("_place", place).where(F.col("_place") <= most).select("lang", "_hash")
    found = may.join(F.broadcast(chosen), ["lang", "_hash"]).groupBy("lang", "_hash").agg(F.first(drawn(F.col("text"))).alias("text"))
    rows = found.collect()  # most rows a language, of TRAIN_CHARS characters
    return [(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r["_hash"]))]


def _predict_batches(model, names: list[str]) -> Callable:
    """Rows whose second column is a text, and its language and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                langs, scores, certain = predict(model.value, part.column(1).to_pylist())
                kept = [part.column(k) for k in range(part.num_columns) if k != 1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(certain, pa.float64())], names)

    return run


def identify_languages(documents: DataFrame, most: int = TRAIN_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, certainty) for each row of documents, and columns to carry along.

    score is the mean odds of lang_pred over a text's words, certainty the mean
    of each word's largest odds, which is high in code-switched text too. Rows
    stay where they are: nothing is shuffled but what is learned from.

    held_out rows, those whose crc32 of the id as text is 1 modulo 3, are never
    learned from. A null or empty text, or one without letters, is `und` with
    score 0, and so is every text where nothing can be learned. A null id is
    not held out and not learned from. Very long texts are read whole, in runs
    that overlap. Repeated rows get equal results, of equally likely languages
    the first in order. An empty table gives no rows; other columns than doc_id,
    text, lang and those carried are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held)
    learned = training_rows(rows, most)
    model = fit([t for t, _ in learned], [x for _, x in learned]) if learned else Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    model = documents.sparkSession.sparkContext.broadcast(model)  # _ROWS rows of a 32-bit number for each language
    own = documents.withColumn("held_out", held).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out", *carry)
    out = StructType([*(own.schema.fields[k] for k in range(len(own.columns)) if k != 1), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("certainty", DoubleType())])
    return own.mapInArrow(_predict_batches(model, out.names), out)
