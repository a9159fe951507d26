"""Toxicity of documents by a bidirectional gated recurrent network over words and their characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.textkeys import _BASE, _power_tables, binary_parts, mix, slices

#: Different texts of each label that the network learns from, at most: those with the smallest hash; and windows of each, drawn from its whole.
TRAIN_TEXTS, TRAIN_WINDOWS = 900, 32
#: Words of a window, and words from one window to the next.
WINDOW, STRIDE = 32, 16
#: Sizes of a word's input and of the state of each direction.
INPUT, STATE = 16, 16
#: Rows of the input tables: words, each length of prefixes, endings and trigrams.
WORDS, PART = 1 << 17, 1 << 16
PREFIXES, ENDING = (3, 4, 5, 6), 3
EPOCHS, BATCH, RATE = 5, 48, 0.01
#: Share of words that are learned from by their characters alone, so that unknown words are understood.
UNKNOWN = 0.5
#: Windows that are scored at a time, and the score from which on a document counts as toxic.
AT_ONCE, THRESHOLD = 2048, 0.3

_U = np.uint64
_ROWS = WORDS + PART * (len(PREFIXES) + 2)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SCORES = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Words:
    """The words of texts: each token's word, the tokens of each text, and each different word's rows of the input tables."""

    token: np.ndarray
    bounds: np.ndarray
    rows: np.ndarray
    owner: np.ndarray
    weight: np.ndarray
    count: int


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The runs of letters of texts in lower-case UTF-8; the parts of a word are found once, however often it occurs."""
    low = int(offsets[0])
    body, at = data[low : int(offsets[-1])], offsets - low
    n = len(body)
    none = np.zeros(0, np.int64)
    if not n:
        return Words(none, np.zeros(len(at), np.int64), none, none, none.astype(np.float32), 0)
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

    keys, first, token = np.unique(run(starts, ends), return_index=True, return_inverse=True)
    own, end = starts[first], ends[first]
    size = end - own
    every = np.arange(len(keys))
    rows, owner, weight = [(keys % _U(WORDS)).astype(np.int64)], [every], [np.ones(len(keys), np.float32)]
    base = WORDS
    for k in PREFIXES:
        has = every[size >= k]
        rows.append(base + (run(own[has], own[has] + k) % _U(PART)).astype(np.int64))
        owner.append(has)
        weight.append(np.ones(len(has), np.float32))
        base += PART
    has = every[size >= ENDING]
    rows.append(base + (run(end[has] - ENDING, end[has]) % _U(PART)).astype(np.int64))
    owner.append(has)
    weight.append(np.ones(len(has), np.float32))
    base += PART
    counts = np.maximum(size - 2, 0)
    of = np.repeat(every, counts)
    start = np.arange(len(of)) + np.repeat(own - np.cumsum(counts) + counts, counts)
    rows.append(base + (run(start, start + 3) % _U(PART)).astype(np.int64))
    owner.append(of)
    weight.append(1 / counts[of].astype(np.float32))
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return Words(token, np.searchsorted(starts, at), np.concatenate(rows)[order], owners[order], np.concatenate(weight)[order], len(keys))


def all_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """words_of for texts of any number, taken a few at a time; a word is another one in each part."""
    parts, bounds, count, tokens = [], [np.zeros(1, np.int64)], 0, 0
    for a, b in slices(offsets):
        own = words_of(data, offsets[a : b + 1])
        parts.append((own.token + count, own.rows, own.owner + count, own.weight))
        bounds.append(own.bounds[1:] + tokens)
        count, tokens = count + own.count, tokens + len(own.token)
    token, rows, owner, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(token, np.concatenate(bounds), rows, owner, weight, count)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, length, text) of all overlapping windows; the last one of a text ends with it."""
    counts = np.diff(bounds)
    parts = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    length = np.minimum(counts, WINDOW)[text]
    first = np.minimum(nth * STRIDE, counts[text] - length)
    return bounds[:-1][text] + first, length, text


def _by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first, axis=0) if len(keys) else values


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


Params = dict[str, np.ndarray]


def fresh(rng: np.random.Generator, dtype: type = np.float32) -> Params:
    """Weights to begin with. into and over hold both directions' gates: update, reset, candidate."""
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(dtype)
    return {
        "table": normal(0.02, _ROWS, INPUT),
        "into": normal(INPUT**-0.5, 2, INPUT, 3 * STATE),
        "shift": np.zeros((2, 3 * STATE), dtype),
        "over": normal(0.5 * STATE**-0.5, 2, STATE, 3 * STATE),
        "look": normal(0.3, 2, STATE),
        "value": normal(0.3, 2, STATE),
        "bias": np.full(1, -2.0, dtype),
    }


def inputs(params: Params, words: Words, known: np.ndarray | None = None) -> np.ndarray:
    """Each different word's input: the sum of the rows of its parts, without its own where it is not known."""
    weight = words.weight
    if known is not None:
        weight = np.where(words.rows < WORDS, weight * known[words.owner], weight)
    if not words.count:
        return np.zeros((0, INPUT), params["table"].dtype)
    return np.add.reduceat(params["table"][words.rows] * weight[:, None], np.searchsorted(words.owner, np.arange(words.count)), axis=0)


def _steps(length: np.ndarray, direction: int) -> Iterator[tuple[int, np.ndarray]]:
    most = int(length.max(initial=0))
    for t in range(most) if direction == 0 else range(most - 1, -1, -1):
        yield t, (length > t)


def attended(look: np.ndarray, value: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention over a window's words, and the pooled value."""
    look = np.where(here, look, -np.inf)
    weight = np.exp(look - look.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    return weight, (weight * value).sum(axis=1)


def window_logits(params: Params, gates: np.ndarray, at: np.ndarray, length: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The logit of each window of words at (window, step); gates are (direction, word, gate).

    keep gathers the states that the gradient needs.
    """
    n, most = at.shape
    look, value = np.zeros((n, most), gates.dtype), np.zeros((n, most), gates.dtype)
    for d in (0, 1):
        h = np.zeros((n, STATE), gates.dtype)
        both = np.stack([params["look"][d], params["value"][d]], axis=1)
        for t, here in _steps(length, d):
            x, o = gates[d][at[:, t]], h @ params["over"][d]
            zr = _sigmoid(x[:, : 2 * STATE] + o[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            c = np.tanh(x[:, 2 * STATE :] + r * o[:, 2 * STATE :])
            new = c + z * (h - c)
            if d:
                new *= here[:, None]
            if keep is not None:
                keep.append((d, t, here, h, z, r, c, o[:, 2 * STATE :], new))
            h = new
            told = h @ both
            look[:, t] += told[:, 0]
            value[:, t] += told[:, 1]
    weight, pooled = attended(look, value, np.arange(most) < length[:, None])
    if keep is not None:
        keep.append((look, value, weight, pooled))
    return pooled + params["bias"][0]


def gradient(params: Params, gates: np.ndarray, at: np.ndarray, length: np.ndarray, slope: Callable[[np.ndarray], np.ndarray]) -> tuple[Params, np.ndarray]:
    """The gradient of a loss of the windows' logits, whose slope is given, by all weights but the inputs', and by gates."""
    kept: list = []
    logits = window_logits(params, gates, at, length, kept)
    of_logits = slope(logits).astype(gates.dtype)
    _, value, weight, pooled = kept.pop()
    out = {k: np.zeros_like(v) for k, v in params.items() if k not in ("table", "into", "shift")}
    out["bias"][0] = of_logits.sum()
    of_value = weight * of_logits[:, None]
    of_look = of_value * (value - pooled[:, None])
    tokens, steps = [[], []], [[], []]
    carried = np.zeros((len(at), STATE), gates.dtype)
    last = None
    while kept:
        d, t, here, h, z, r, c, o, new = kept.pop()
        if d != last:
            carried, last = np.zeros_like(carried), d
        own = here[:, None].astype(gates.dtype)
        # padded steps are none: their attention is zero, and backwards they leave no state
        grad = carried + of_look[:, t, None] * params["look"][d] + of_value[:, t, None] * params["value"][d]
        out["look"][d] += of_look[:, t] @ new
        out["value"][d] += of_value[:, t] @ new
        if d:
            grad = grad * own
        of_c = grad * (1 - z) * (1 - c * c)
        of_z = grad * (h - c) * z * (1 - z)
        of_r = of_c * o * r * (1 - r)
        of_o = np.concatenate([of_z, of_r, of_c * r], axis=1)
        out["over"][d] += h.T @ of_o
        carried = grad * z + of_o @ params["over"][d].T
        tokens[d].append(at[:, t])
        steps[d].append(np.concatenate([of_z, of_r, of_c], axis=1))
    of_gates = np.zeros_like(gates)
    for d in (0, 1):
        keys, sums = _by_key(np.concatenate(tokens[d]), np.concatenate(steps[d]))
        of_gates[d][keys] = sums
    return out, of_gates


def any_window(text: np.ndarray, labels: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The slope of the loss of texts that are toxic if any of their windows is; text has each window's."""

    def slope(logits: np.ndarray) -> np.ndarray:
        logits = logits.astype(np.float64)
        odds = _sigmoid(logits)
        clean = np.bincount(text, -np.logaddexp(0, logits), len(labels))  # log of the odds that no window is
        found = np.maximum(-np.expm1(clean), 1e-12)
        return np.where(labels[text] == 1, -(np.exp(clean) / found)[text] * odds, odds) / len(labels)

    return slope


def learn(texts: list[list[str]], labels: list[int], epochs: int = EPOCHS) -> Params:
    """Weights from texts, each given by windows, by Adam on the loss of texts that are toxic if any window is."""
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    data, offsets = binary_parts(pa.array([w for t in texts for w in t], pa.large_string()))
    words = all_words(data, offsets)
    truth, rng = np.array(labels), np.random.default_rng(11)
    params = fresh(rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    feature_at = np.searchsorted(words.owner, np.arange(words.count + 1))
    first, lengths = words.bounds[:-1], np.diff(words.bounds)
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            place = np.full(len(texts), -1)
            place[batch] = np.arange(len(batch))
            own = np.flatnonzero((place[of] >= 0) & (lengths > 0))
            if not len(own):
                continue
            at = first[own, None] + np.minimum(np.arange(lengths[own].max()), lengths[own, None] - 1)
            used, local = np.unique(words.token[at], return_inverse=True)
            local = local.reshape(at.shape)
            # the parts of the words of this batch
            counts = feature_at[used + 1] - feature_at[used]
            owner = np.repeat(np.arange(len(used)), counts)
            part = np.arange(len(owner)) + np.repeat(feature_at[used] - np.cumsum(counts) + counts, counts)
            some = Words(local, np.zeros(0, np.int64), words.rows[part], owner, words.weight[part], len(used))
            known = (rng.random(len(used)) >= UNKNOWN).astype(np.float32)
            x = inputs(params, some, known)
            gates = np.stack([x @ params["into"][d] + params["shift"][d] for d in (0, 1)])
            grads, of_gates = gradient(params, gates, local, lengths[own], any_window(place[of[own]], truth[batch]))
            grads["into"] = np.stack([x.T @ of_gates[d] for d in (0, 1)])
            grads["shift"] = of_gates.sum(axis=1)
            of_x = of_gates[0] @ params["into"][0].T + of_gates[1] @ params["into"][1].T
            weight = np.where(some.rows < WORDS, some.weight * known[owner], some.weight)
            rows, of_rows = _by_key(some.rows, of_x[owner] * weight[:, None])
            step += 1
            for name in params:
                value, (mean, square) = params[name], moments[name]
                where, grad = (rows, of_rows) if name == "table" else (slice(None), grads[name])
                mean[where] = 0.9 * mean[where] + 0.1 * grad
                square[where] = 0.99 * square[where] + 0.01 * grad * grad
                value[where] -= rate * (mean[where] / (1 - 0.9**step)) / (np.sqrt(square[where] / (1 - 0.99**step)) + 1e-6)
    return params


def scores(params: Params | None, texts: list[str | None]) -> np.ndarray:
    """The largest odds of any window of each text; those of an empty window for a text without words."""
    if params is None:
        return np.zeros(len(texts))
    out = np.full(len(texts), params["bias"][0], np.float64)
    found = np.full(len(texts), -np.inf)
    data, offsets = binary_parts(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    for a, b in slices(offsets):
        words = words_of(data, offsets[a : b + 1])
        x = inputs(params, words)
        gates = np.stack([x @ params["into"][d] + params["shift"][d] for d in (0, 1)])
        first, length, text = windows(words.bounds)
        for s in range(0, len(first), AT_ONCE):
            part = slice(s, s + AT_ONCE)
            at = first[part, None] + np.minimum(np.arange(length[part].max()), length[part, None] - 1)
            np.maximum.at(found, a + text[part], window_logits(params, gates, words.token[at], length[part]))
    return _sigmoid(np.where(np.isfinite(found), found, out))


def _drawn_windows(most: int) -> Callable:
    """Rows (hash, toxic, text) to (hash, toxic, windows): most windows of the whole text, drawn by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                body = text.as_py().lower().encode()
                data = np.frombuffer(body, np.uint8)
                letter = np.append(_LETTER[data], False)
                edges = np.flatnonzero(np.diff(letter, prepend=False))
                first, length, _ = windows(np.array([0, len(edges) // 2]))
                picked = np.sort(np.random.default_rng(key % (1 << 63)).permutation(len(first))[:most])
                kept.append([b" ".join(body[edges[2 * w] : edges[2 * w + 1]] for w in range(first[k], first[k] + length[k])).decode() for k in picked])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.string()))], ["hash", "toxic", "windows"])

    return run


def training_texts(documents: DataFrame, labels: DataFrame, most: int = TRAIN_TEXTS, each: int = TRAIN_WINDOWS) -> list[tuple[list[str], int]]:
    """(windows, toxic) of at most `most` different texts of each label, those with the smallest hash.

    A text is toxic if any of the learnable labels of its documents says so;
    copies of it are one. Only hashes of texts are shuffled; the chosen texts,
    a bounded number, are read by them, and no more than `each` windows of one
    reach the driver.
    """
    may = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))
    told = labels.where(may & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    texts = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    marked = texts.select("doc_id", "hash").join(told, "doc_id").groupBy("hash").agg(F.max("toxic").cast("int").alias("toxic"))
    mixed = F.xxhash64(F.col("hash"), F.lit("toxicity"))
    chosen = [r for y in (0, 1) for r in marked.where(F.col("toxic") == y).orderBy(mixed, "hash").limit(most).collect()]
    if not chosen:
        return []
    wanted = F.broadcast(documents.sparkSession.createDataFrame(chosen, "hash long, toxic int"))  # twice most rows at most
    found = texts.join(wanted, "hash").groupBy("hash", "toxic").agg(F.first("text").alias("text"))
    rows = found.mapInArrow(_drawn_windows(each), "hash long, toxic int, windows array<string>").collect()
    return [(r.windows, r.toxic) for r in sorted(rows, key=lambda r: r.hash) if r.windows]


def _scored_batches(params) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = params.value and params.value | {"table": params.value["table"].astype(np.float32)}
        for batch in batches:
            own = scores(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array((own >= THRESHOLD).astype(np.int32))], [c.split()[0] for c in SCORES.split(", ")])

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, most: int = TRAIN_TEXTS) -> DataFrame:
    """Rows of SCORES for each row of documents.

    A word's input sums up rows of tables for the word, its prefixes, ending
    and trigrams. Over windows of 32 words, one every 16, a gated recurrent
    network reads them in both directions, attention pools its states, and a
    document's score is the largest of its windows', of which none is left
    out. Rows stay where they are: nothing is shuffled but what is learned from.

    held_out rows, those whose crc32 of the id as text is 2 modulo 4, are never
    learned from; a null id is not held out and has no label. Labels other than
    0 and 1 count as none; of several labels of a document the largest counts.
    A text that is null, empty or without letters has the score of an empty
    window. Very long texts are read whole. Equal texts have equal scores. If
    labels of either kind are missing all scores are 0. An empty table gives no
    rows; other columns than doc_id and text are not read.
    """
    learned = training_texts(documents, labels, most)
    params = learn(*map(list, zip(*learned, strict=True))) if {y for _, y in learned} == {0, 1} else None
    if params:
        params["table"] = params["table"].astype(np.float16)
    params = documents.sparkSession.sparkContext.broadcast(params)  # _ROWS rows of INPUT 16-bit numbers, 17 MB
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(_scored_batches(params), SCORES)
