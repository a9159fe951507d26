"""The toxicity network: its gradient, its windows, odd rows, and what it finds in held-out documents."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from streamloom.llm import toxicity as tox
from streamloom.llm.textkeys import binary_parts
from tests.llm.test_operators import ODD, table

LABELS = "doc_id long, quality int, toxic int"


def _words(texts):
    return tox.words_of(*binary_parts(pa.array(texts, pa.large_string())))


def test_words_and_windows_of_texts():
    texts = ["one two, two three", "", "x1y é-été", " ".join(f"w{'abcdefghij'[k % 10]}" for k in range(77)), "a"]
    words = _words(texts)
    counts = np.diff(words.bounds).tolist()
    assert counts == [len(re.findall(r"[^\W\d_]+", t)) for t in texts]
    assert words.token[1] == words.token[2] != words.token[0] and words.count == len({w for t in texts for w in re.findall(r"[^\W\d_]+", t)})
    first, length, text = tox.windows(words.bounds)
    for k, n in enumerate(counts):
        own = [(int(f - words.bounds[k]), int(w)) for f, w, t in zip(first, length, text, strict=True) if t == k]
        starts = [] if not n else [0] if n <= tox.WINDOW else [*range(0, n - tox.WINDOW, tox.STRIDE), n - tox.WINDOW]
        assert own == [(s, min(n, tox.WINDOW)) for s in starts]


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    params = {k: v.astype(np.float64) for k, v in tox.fresh(rng).items()}
    labels, text = np.array([1, 0, 1]), np.array([0, 0, 1, 1, 2])
    length = np.array([5, 2, 3, 1, 4])
    at = rng.integers(0, 9, (5, 5))
    gates = rng.standard_normal((2, 9, 3 * tox.STATE))

    def loss(params, gates):
        clean = np.bincount(text, -np.logaddexp(0, tox.window_logits(params, gates, at, length)), 3)
        return -np.where(labels == 1, np.log(-np.expm1(clean)), clean).mean()

    grads, of_gates = tox.gradient(params, gates, at, length, tox.any_window(text, labels))
    for name, own in [*grads.items(), ("gates", of_gates)]:
        for _ in range(12):
            where = tuple(rng.integers(0, n) for n in own.shape)
            moved = []
            for d in (1e-5, -1e-5):
                p, g = {k: v.copy() for k, v in params.items()}, gates.copy()
                (g if name == "gates" else p[name])[where] += d
                moved.append(loss(p, g))
            assert own[where] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-6)


def test_scores_are_those_of_plain_loops_over_windows():
    params = {k: v.astype(np.float64) for k, v in tox.fresh(np.random.default_rng(4)).items()}
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcé", k=rng.randrange(1, 9))) for _ in range(n)) for n in (1, 2, 31, 32, 33, 100)]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    s = tox.STATE

    def one(x):
        told = []
        for d in (0, 1):
            h, out = np.zeros(s), []
            for v in x if d == 0 else x[::-1]:
                g, o = v @ params["into"][d] + params["shift"][d], h @ params["over"][d]
                z, r = sigmoid(g[:s] + o[:s]), sigmoid(g[s : 2 * s] + o[s : 2 * s])
                h = (1 - z) * np.tanh(g[2 * s :] + r * o[2 * s :]) + z * h
                out.append(h)
            told.append(out if d == 0 else out[::-1])
        look = np.array([f @ params["look"][0] + b @ params["look"][1] for f, b in zip(*told, strict=True)])
        value = np.array([f @ params["value"][0] + b @ params["value"][1] for f, b in zip(*told, strict=True)])
        weight = np.exp(look) / np.exp(look).sum()
        return weight @ value + params["bias"][0]

    for text, got in zip(texts, tox.scores(params, texts), strict=True):
        words = _words([text])
        x = tox.inputs(params, words)[words.token]
        starts = [0] if len(x) <= tox.WINDOW else [*range(0, len(x) - tox.WINDOW, tox.STRIDE), len(x) - tox.WINDOW]
        assert got == pytest.approx(sigmoid(max(one(x[k : k + tox.WINDOW]) for k in starts)))


def test_toxic_documents_are_found(spark):
    rng = random.Random(3)
    clean = [f"{a}{b}{c}" for a in ("mo", "ta", "li", "su") for b in ("ner", "las", "vit") for c in ("o", "en", "ir", "a")]
    ends = ["um", "ox", "ipe", "arn", "ettu", "ibo", "olk", "ay"]
    rows, labels = [], []
    for k in range(1200):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 400))]
        toxic = k % 6 == 0
        for _ in range(3 * toxic):
            # stems with endings of which some occur in held-out documents alone
            words[rng.randrange(len(words))] = rng.choice(["zqurf", "krazb"]) + rng.choice(ends)
        rows.append((k, " ".join(words), "en", "a", 1))
        labels.append((k, 1, int(toxic)))
    got = {r.doc_id: r for r in tox.score_toxicity(table(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == 1200 and all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for k, r in got.items())
    held = [(got[k].predicted, y) for k, _, y in labels if got[k].held_out]
    assert sum(p != y for p, y in held) <= 0.02 * len(held) and sum(y for _, y in held) > 30


def test_held_out_labels_and_other_columns_change_nothing(spark):
    rows = [(k, f"some words here number{'abc'[k % 3]}" + " vile" * (k % 2), "en", "a", 1) for k in range(60)]
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    first = [(k, 1, k % 2) for k in range(60)]
    other = [(k, 0, 1 - k % 2 if held(k) else k % 2) for k in range(60)] + [(None, 1, 1), (3, 1, None), (4, 1, 7)]
    run = lambda rows, labels: sorted((r.doc_id, r.score) for r in tox.score_toxicity(table(spark, rows), spark.createDataFrame(labels, LABELS)).collect())
    assert run(rows, first) == run([(r[0], r[1], "xx", None, 9) for r in rows], other)


def test_copies_are_learned_from_once(spark):
    rows = [(k, "the same text", "en", "a", 1) for k in range(500)] + [(1000 + k, f"text {'abcdef'[k]}", "en", "a", 1) for k in range(6)]
    labels = spark.createDataFrame([(r[0], 1, 1 if r[0] == 7 else 0) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 or r[0] == 7], LABELS)
    learned = tox.training_texts(table(spark, rows), labels)
    assert [w for w, _ in learned].count(["the same text"]) == 1 and len(learned) <= 7


def test_toxicity_of_odd_rows(spark):
    labels = [(4, 1, 1), (5, 1, 0), (8, 1, 0), (6, 0, 1), (7, 0, 0), (-3, 1, 1), (1, 1, 1), (2, 1, 0)]
    odd = table(spark, ODD, extra=True)
    got = tox.score_toxicity(odd, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.score) == r.score
    assert by_id[1] == by_id[2] == by_id[3]
    for none in ([], [(4, 1, 0)], [(4, 1, 1)]):
        assert {r.score for r in tox.score_toxicity(odd, spark.createDataFrame(none, LABELS)).collect()} == {0.0}
    assert tox.score_toxicity(table(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []
