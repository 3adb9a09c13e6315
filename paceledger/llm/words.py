"""Vectorised word splitting and hashing over Arrow string batches.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; multi-byte UTF-8
sequences never hold those bytes, so byte runs equal character runs. All
functions work on slices of a few hundred kilobytes of text at a time, which
bounds a Python worker's memory whatever the batch or document sizes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240611)
#: One random 64-bit value per byte and per lane: fixed values, as hashes must agree between tasks.
_BYTE = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LEFT = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9FB21C651E98DF25))
_RIGHT = (np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Slice:
    """Consecutive documents of a batch: ``data`` is their text; word i is data[starts[i]:ends[i]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def word_offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self, lane: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; lanes are independent hashes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lens = self.ends - self.starts
        inside = ~_SPACE[self.data]
        own = self.data[inside]
        if lower:
            own = _LOWER[own]
        first = np.cumsum(lens) - lens
        place = np.arange(len(own)) - np.repeat(first, lens)
        power = np.empty(int(lens.max()) + 1, dtype=np.uint64)
        power[0] = 1
        power[1:] = _BASE[lane]
        np.multiply.accumulate(power, out=power)
        sums = np.add.reduceat(_BYTE[lane][own] * power[place], first)
        return mix(sums + lens.astype(np.uint64) * _RIGHT[lane])


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Split a string column into runs of whole documents of about ``limit`` bytes (one document at least)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield _split(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def _split(first: int, data: np.ndarray, offsets: np.ndarray) -> Slice:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    counts = np.diff(np.searchsorted(starts, offsets))
    return Slice(first, data, offsets, starts, ends, counts)


def doubled(hashes: np.ndarray, have: int, want: int, lane: int = 0) -> np.ndarray:
    """Hashes of windows of ``want`` words from those of ``have`` words, have <= want <= 2 * have.

    A window of the new length is named by two windows of the old length that
    together cover it, as in repeated doubling. The result has one value for
    each start at which the longer window fits.
    """
    step = want - have
    n = max(0, len(hashes) - step)
    return mix(hashes[:n] * _LEFT[lane] + hashes[step : step + n] * _RIGHT[lane] + np.uint64(want))


def windows(hashes: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hashes of all windows of ``length`` words, by doubling from one word."""
    have = 1
    while have < length:
        want = min(2 * have, length)
        hashes = doubled(hashes, have, want, lane)
        have = want
    return hashes


def fits(counts: np.ndarray, length: int) -> np.ndarray:
    """Of all window starts over the joined words of several documents: which stay inside one document."""
    total = int(counts.sum())
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return left[: max(0, total - length + 1)] >= length
