"""Words, word hashes and bounded slices of Arrow batches, shared by the operators that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once inside a task; longer texts come alone.
CHUNK_BYTES = 2 << 20


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose texts hold about ``limit`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: Odd, so that it has an inverse among 64-bit numbers.
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, 2 to the power ``bits`` of each (wrapping at 64 bits)."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        values = np.ones(1 << bits, np.uint64)
        for k in range(bits):
            values[1 << k : 2 << k] = values[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
        out.append(values)
    return out[0], out[1]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every lower-case word of all texts, and where each text's words begin (one more at the end).

    Words are split at ASCII white space. All of them are hashed at once: a running polynomial over the bytes, whose differences
    at word ends, shifted back to one place, depend on the word only.
    """
    lowered = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    bounds = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    if not len(lowered) or bounds[-1] == bounds[0]:
        return np.empty(0, np.uint64), np.zeros(len(lowered) + 1, np.int64)
    data = np.frombuffer(lowered.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, back = _powers(max(20, len(data).bit_length()))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=running[1:])
    return mixed((running[last] - running[first]) * back[first]), np.searchsorted(first, bounds)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed one-to-one mapping)."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(29))


def grams(hashed: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of ``n`` words and where each text's runs begin. A text of 1 to n-1 words has one run, itself."""
    out = np.zeros(len(hashed) + n - 1, np.uint64)
    out[: len(hashed)] = hashed
    padded = out.copy()
    for k in range(1, n):
        out[: len(hashed)] = mixed(out[: len(hashed)] * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(hashed)])
    lengths = np.diff(offsets)
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    begins = np.concatenate(([0], np.cumsum(counts)))
    at = np.repeat(offsets[:-1] - begins[:-1], counts) + np.arange(begins[-1])
    found = out[at]
    for i in np.flatnonzero((lengths > 0) & (lengths < n)):
        value = np.zeros(1, np.uint64)
        for word in hashed[offsets[i] : offsets[i + 1]]:
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1))
        found[begins[i]] = value[0]
    return found, begins
