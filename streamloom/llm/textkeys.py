"""Words and word shingles of Arrow text columns as 64-bit keys, in numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. A
document's shingles are its runs of five words; with one to four words the
whole sequence is the only one; without words there is none. Keys are equal
for equal shingles; two different ones meet with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes that are hashed at a time; a longer document is taken alone.
STEP = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STRIDES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], _U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; a null is empty."""
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each word, and the bounds of each document's words."""
    low = int(offsets[0])
    body, bounds = data[low : int(offsets[-1])], offsets - low
    n = len(body)
    if not n:
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    word = ~_SPACE[body]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (edge[:-1] | ~before))
    ends = np.flatnonzero(word & (edge[1:] | ~after)) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((_LOWER[body].astype(_U) + _U(1)) * up[:n], out=sums[1:])
    keys = (sums[ends] - sums[starts]) * down[starts]
    return mix(keys + (ends - starts).astype(_U) * _U(_BASE)), np.searchsorted(starts, bounds)


def shingle_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each shingle, repeats included, and the bounds of each document's."""
    words, bounds = word_keys(data, offsets)
    counts = np.diff(bounds)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    n = len(words)
    full = np.zeros(max(0, n - SHINGLE + 1), _U)
    for k in range(SHINGLE):
        full += words[k : k + len(full)] * _STRIDES[k]
    # the position of each shingle's first word
    at = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[:-1], sizes)
    keys = np.zeros(out[-1], _U)
    long = np.repeat(counts >= SHINGLE, sizes)
    keys[long] = mix(full[at[long]])
    for d in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        own = words[bounds[d] : bounds[d + 1]]
        keys[out[d] : out[d] + 1] = mix((own * _STRIDES[: len(own)]).sum(keepdims=True) + _U(len(own)))
    return keys, out


def slices(offsets: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of documents of about step bytes."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1)
        yield first, last
        first = last


def shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, keys, bounds) for runs of a column's documents."""
    data, offsets = binary_parts(column)
    for first, last in slices(offsets):
        yield first, last, *shingle_keys(data, offsets[first : last + 1])
