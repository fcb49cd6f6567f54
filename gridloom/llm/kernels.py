"""Vectorised text kernels over Arrow string buffers.

Words never become Python objects: a slice of documents is one byte array, word
hashes come from prefix sums of a polynomial in 64-bit arithmetic, and all that
follows (shingles, minhashes, fingerprints) is numpy over those hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; the working set is about forty times as large.
SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]

#: Bytes that belong to words: everything but white space, or ASCII letters and digits with all non-ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, dtype=bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_a:_b] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most ``limit`` bytes, or one longer row. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word's number of each document (one entry more than documents)."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    inside = table[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_CODE[data] * _power("base", _BASE, len(data))[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * _power("inverse", _INV, len(data))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; runs that cross documents are for the caller to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    g = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        g *= np.uint64(0x9FB21C651E98DF25)
        g += h[i : i + n]
    return mix(g)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence, apart from all hashes that grams() gives."""
    g = np.uint64(len(h) + 77)
    with np.errstate(over="ignore"):
        for x in h:
            g = g * np.uint64(0x9FB21C651E98DF25) + x
    return mix(np.array([g], dtype=np.uint64))[0]


def shingle_lists(data: np.ndarray, offsets: np.ndarray, k: int, table: np.ndarray = SPACED) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; fewer words make one shingle, none make none."""
    starts, ends, first = words(data, offsets, table)
    h = hashes(data, starts, ends)
    g = grams(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            keep = np.empty(len(x), dtype=bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(np.array([sequence_hash(h[a:b])], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def minhashes(sets: list[np.ndarray], count: int, seed: int) -> np.ndarray:
    """count minhashes of each set that isn't empty, as rows."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = rng.integers(1, 1 << 63, count, dtype=np.uint64)
    out = np.empty((len(sets), count), dtype=np.uint64)
    if not sets:
        return out
    # Runs of sets of about 8,000 values stay in cache over all factors.
    at, sizes = 0, [len(s) for s in sets]
    while at < len(sets):
        end, total = at + 1, sizes[at]
        while end < len(sets) and total + sizes[end] <= 8000:
            total += sizes[end]
            end += 1
        flat = np.concatenate(sets[at:end])
        bounds = np.concatenate(([0], np.cumsum(sizes[at : end - 1]))).astype(np.int64)
        for j in range(count):
            v = (flat ^ flips[j]) * factors[j]
            v ^= v >> np.uint64(32)
            out[at:end, j] = np.minimum.reduceat(v, bounds)
        at = end
    return out


def parity_sketch(values: np.ndarray, longs: int) -> np.ndarray:
    """Bit i is the parity of how many values fall to it, so the sketches of two sets differ in at most as many bits as the sets do."""
    bits = np.bincount((values >> np.uint64(11)).astype(np.int64) & (longs * 64 - 1), minlength=longs * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def list_column(values: np.ndarray, counts) -> pa.ListArray:
    """An Arrow list column of 64-bit integers from flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).view(np.int64)))


def sparing(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """run (of one table or two), which then gives the memory that Arrow keeps for later back: an idle worker would hold it for the next stages too."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            pa.default_memory_pool().release_unused()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            pa.default_memory_pool().release_unused()

    return one if run.__code__.co_argcount == 1 else two
