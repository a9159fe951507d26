"""The alignment of two tokenizers against plain loops over whole texts."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from streamloom.llm import alignment
from streamloom.llm.alignment import ByteTokens, PieceTokens, align_tokens, default_tokenizers, diagonals, merged
from tests.llm.test_operators import DOCS, ODD, table

PATHS = default_tokenizers()
TEXTS = [
    "The  quick\tbrown fox's jump",
    " leading",
    "trailing ",
    "two  ",
    "   ",
    "\n",
    "a\n\nb \n c",
    "<|endoftext|> <s>x</s> <0x41> <unk>",
    "▁ literal",
    "naïve ünï　code \U0001f600\U0001f469‍\U0001f469 €",
    "é vs é",
    "\x00\x1f\x7f",
    "漢字かな交じり文",
    "x" * 300,
    "supercalifragilistic " * 20,
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def plain():
    """(tokens of A, tokens of B), each as ids and bytes, by whole texts."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def tokens(text):
        if not text:
            return [], []
        own = [(k, bytes(byte[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
        other = []
        for k in b.encode(text):
            piece = b.id_to_piece(k)
            other.append((k, bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (own, other) if all(b"".join(x for _, x in side) == whole for side in (own, other)) else ([], [])

    return tokens


def spans(tokens):
    out, at = [], 0
    for k, x in tokens:
        out.append((k, at, at + len(x)))
        at += len(x)
    return out


def model(rows, tokens):
    found, counts = [], Counter()
    for doc, text in rows:
        a, b = map(spans, tokens(text))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 2000 else [(x[0], y[0]) for x, y in _swept(a, b)]
        counts.update(links)
        shared = sorted({x[2] for x in a} & {y[2] for y in b})
        by_end = defaultdict(lambda: ([], []))
        for side, own in enumerate((a, b)):
            for k, _, end in own:
                by_end[shared[bisect_left(shared, end)]][side].append(str(k))
        groups = [",".join(by_end[e][0]) + "|" + ",".join(by_end[e][1]) for e in shared]
        found.append((doc, len(a), len(b), len(shared), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(((d, a, b, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), h) for d, a, b, g, x, h in found), key=repr)


def _swept(a, b):
    i = j = 0
    while i < len(a) and j < len(b):
        yield a[i], b[j]
        i, j = i + (a[i][2] <= b[j][2]), j + (b[j][2] <= a[i][2])


def test_words_give_the_ids_of_whole_texts(plain, docs):
    a, b = ByteTokens(PATHS[0]), PieceTokens(PATHS[1])
    assert b.by_words and a.by_words
    for text in TEXTS + [r.text for r in docs.select("text").collect()]:
        own, other = plain(text)
        if own:
            assert np.frombuffer(a.of(text), "<u4").tolist() == [k for k, _ in own]
            assert np.frombuffer(b.of(text), "<u4").tolist() == [k for k, _ in other]


def test_diagonals_part_the_merge_evenly():
    rng = np.random.default_rng(3)
    for n, m, step in ((0, 0, 4), (1, 0, 4), (0, 9, 4), (50, 70, 7), (200, 3, 16), (90, 90, 1)):
        a, b = np.sort(rng.integers(0, 60, n)), np.sort(rng.integers(0, 60, m))
        order = np.argsort(np.concatenate([a, b]), kind="stable") < n
        first, second = diagonals(a, b, step)
        at = first + second
        assert at[0] == 0 and at[-1] == n + m and (np.diff(at)[:-1] == step).all()
        assert first.tolist() == [int(order[:k].sum()) for k in at]


@pytest.mark.parametrize("step", [1, 2, 3, 8, 1000])
def test_pieces_of_any_size_give_all_overlaps_and_cuts(step):
    rng = random.Random(step)
    for _ in range(60):
        size = rng.randrange(1, 60)
        a, b = (np.array(sorted({size, *(rng.randrange(1, size + 1) for _ in range(rng.randrange(20)))})) for _ in range(2))
        link_a, link_b, cut_a, cut_b = merged(a, b, step)
        begin = lambda x: np.append(0, x[:-1])
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if begin(a)[i] < b[j] and begin(b)[j] < a[i]]
        assert list(zip(link_a.tolist(), link_b.tolist(), strict=True)) == want
        assert list(zip(cut_a.tolist(), cut_b.tolist(), strict=True)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]


@pytest.mark.parametrize("blocks", [1, 7])
def test_alignment_equals_plain_loops(spark, plain, blocks):
    rows = [(k, t) for k, t in enumerate(TEXTS + TEXTS[:3])] + [(r[0], r[1]) for r in ODD]
    own = table(spark, [(k, t, None, None, 0) for k, t in rows], extra=True)
    got = sorted((tuple(r) for r in align_tokens(own.repartition(blocks)).collect()), key=repr)
    assert got == model(rows, plain)


def test_alignment_of_documents(spark, plain, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in align_tokens(docs).collect()), key=repr)
    assert got == model(rows, plain) and any(r[1] == 0 for r in got) == any(not plain(t)[0] for _, t in rows)


def test_blocks_keep_their_links():
    for n in (0, 1, 300, 70_000):
        ranks = np.arange(n) * 7919 % 65_537 * 3000
        assert alignment._unpacked(alignment._packed(ranks), n).tolist() == ranks.tolist()


def test_alignment_of_nothing(spark):
    assert align_tokens(table(spark, [], DOCS)).collect() == []
