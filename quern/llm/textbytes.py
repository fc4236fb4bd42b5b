"""Words of Arrow text columns as numpy arrays: spans and 64-bit hashes without a Python loop over words.

A word is a maximal run of bytes without ASCII white space; ASCII letters count in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_VALUE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)[LOWER]
CHUNK = 1 << 20


@dataclass
class Words:
    """rows: positions of the texts in their batch. Word i spans data[start[i]:end[i]] and belongs to rows[row[i]]."""

    rows: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # first[r]: index of the first word of text r; one more entry than rows
    bounds: np.ndarray  # bounds[r]: first byte of text r; one more entry than rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null has no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return offsets, data


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK bytes; a longer text has a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(column: pa.Array) -> Iterator[Words]:
    offsets, data = raw(column)
    for lo, hi in chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        bounds = offsets[lo : hi + 1] - offsets[lo]
        dark = ~BLANK[part]
        opens, closes = dark.copy(), dark.copy()
        opens[1:] &= ~dark[:-1]
        closes[:-1] &= ~dark[1:]
        inner = bounds[(bounds > 0) & (bounds < len(part))]
        opens[inner] = dark[inner]
        closes[inner - 1] = dark[inner - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        first = np.searchsorted(start, bounds)
        yield Words(np.arange(lo, hi), part, start, end, np.repeat(np.arange(hi - lo), np.diff(first)), first, bounds)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 2**64)
    up, down = np.full(n, _BASE), np.full(n, np.uint64(inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans: a polynomial modulo 2**64 from prefix sums, then mixed."""
    size = CHUNK + 1
    while size <= len(data) + 1:
        size *= 2
    up, down = _powers(size)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of n words of each text, sorted by text, and where each text's begin. A text of fewer words has one run, of them all; a text without words has none."""
    h = span_hashes(w.data, w.start, w.end)
    counts = np.diff(w.first)
    runs = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(w.first[:-1], runs)
    left = np.minimum(n, counts)[row]
    key = np.zeros(len(row), np.uint64)
    for k in range(n):
        have = k < left
        part = h[np.where(have, at + k, 0)] if len(h) else np.zeros(len(row), np.uint64)
        key = np.where(have, mix(key * np.uint64(0x2545F4914F6CDD1D) + part + np.uint64(k + 1)), key)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[fresh], row[fresh]
    return key, np.searchsorted(row, np.arange(len(counts) + 1))


def all_shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of every text of the column: keys and where each text's begin."""
    keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for w in words(column):
        key, first = shingles(w, n)
        keys.append(key)
        sizes.append(np.diff(first))
    return np.concatenate(keys), np.cumsum(np.concatenate(sizes))
