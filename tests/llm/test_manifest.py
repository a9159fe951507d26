"""The Merkle manifest against a plain model, with odd, repeated and scattered ids."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from streamloom.llm.manifest import merkle_manifest
from tests.llm.test_operators import DOCS, ODD, table

_LOWER = {k: k + 32 for k in range(65, 91)}


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_sha(*last[k : k + 16]) for k in range(0, len(last), 16)])
    return levels


def _path(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at - at % 16 : at - at % 16 + 16]
        out.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        at //= 16
    return out


def model(rows):
    """The manifest's rows; equal rows and their proofs are matched as a multiset."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0] is not None, r[0] or 0, _leaf(r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order}
    top = _levels([trees[s][-1][0] for s in order])
    out = Counter()
    for k, s in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = _path(trees[s], at) + _path(top, k)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                node = _leaf((r[0], r[1].translate(_LOWER), *r[2:]))
            for before, after in path:
                node = _sha(before, node, after)
            out[(r[0], leaf, trees[s][-1][0], top[-1][0], _sha(*(b + a for b, a in path)), node, node == top[-1][0])] += 1
    return out


def _rows(ids, sources, rng):
    return [(i, rng.choice(["Some Text", "other text", f"Text {k}"]), "en", rng.choice(sources), k % 3) for k, i in enumerate(ids)]


_RNG = random.Random(5)
CASES = {
    "one": [(7, "A", None, None, None)],
    "odd": ODD,
    "neighbours": _rows(range(-40, 700), ["a", "b", "é", None], _RNG),
    "scattered": _rows([_RNG.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [(1 << 63) - 1, -(1 << 63), 63, 64, -1, 0], ["a"], _RNG),
    "of one id": _rows([5] * 900 + [None] * 900 + [6, 4], ["a", None], _RNG),
    "many sources": _rows(range(400), [f"s{k}" for k in range(90)], _RNG),
    "equal rows": [(3, "X y", "en", "a", 1)] * 5000 + [(2, "X", "en", "a", 1)],
}


@pytest.mark.parametrize("name", CASES)
def test_manifest_equals_a_plain_model(name, spark):
    rows = CASES[name]
    got = Counter(tuple(r) for r in merkle_manifest(table(spark, rows, extra=name == "odd")).collect())
    assert got == model(rows)


def test_manifest_tells_what_was_changed(spark):
    rows = [(k, "ABC" if k % 2 else "abc", "en", "a", 3) for k in range(200)]
    changed = {r.doc_id for r in merkle_manifest(table(spark, rows)).where("NOT verified").collect()}
    assert changed == {k for k in range(200) if k % 2 and zlib.crc32(str(k).encode()) % 5 == 0}


def test_manifest_of_nothing(spark):
    assert merkle_manifest(table(spark, [], DOCS)).collect() == []
