"""Vectorised work on the UTF-8 bytes of Arrow text batches, used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

#: Fixed value: the bytes between words, [\x20\x09-\x0D].
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

_SEP = np.zeros(256, dtype=bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base, and of its inverse, for n bytes at least."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        base, inv = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        out = []
        for b in (base, inv):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers, _inverse = out
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """The texts of one small batch as a byte array: document i has bytes off[i] to off[i + 1]."""

    def __init__(self, array: pa.Array, lower: bool = False):
        array = array.fill_null("") if array.null_count else array
        width = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
        n = len(array)
        _, offsets, data = array.buffers()
        off = np.frombuffer(offsets, dtype=width, count=array.offset + n + 1)[array.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.n = n
        self.off = off - off[0]
        self.buf = _LOWER[raw] if lower else raw
        self._hash = None

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, positions, side="right") - 1

    def sum_by_doc(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.buf) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.off])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes other than separators, never across documents."""
        ink = ~_SEP[self.buf]
        if not len(ink):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(len(ink) + 1, dtype=bool)
        edge[self.off] = True
        start = ink.copy()
        start[1:] &= ~ink[:-1] | edge[1:-1]
        end = ink.copy()
        end[:-1] &= ~ink[1:] | edge[1:-1]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def runs(self, ink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes for which ink holds, never across documents."""
        edge = np.zeros(len(ink) + 1, dtype=bool)
        edge[self.off] = True
        before, after = np.concatenate(([False], ink[:-1])), np.concatenate((ink[1:], [False]))
        return np.flatnonzero(ink & (~before | edge[:-1])), np.flatnonzero(ink & (~after | edge[1:])) + 1

    def prefix_hash(self) -> np.ndarray:
        if self._hash is None:
            power, _ = _grow(len(self.buf) + 1)
            h = np.zeros(len(self.buf) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.buf] * power[: len(self.buf)], out=h[1:])
            self._hash = h
        return self._hash

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes give equal values in any batch."""
        h = self.prefix_hash()
        _, inverse = _grow(len(self.buf) + 1)
        return mix((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))

    def rolling(self, k: int) -> np.ndarray:
        """64-bit hashes of the k bytes from each place on, whatever documents they are in."""
        h = self.prefix_hash()
        _, inverse = _grow(len(self.buf) + 1)
        return (h[k:] - h[:-k]) * inverse[: len(self.buf) - k + 1]

    def per_doc(self, starts: np.ndarray) -> np.ndarray:
        """Bounds of each document's part of a sorted array of positions."""
        return np.searchsorted(starts, self.off)


def windows(values: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k values inside each document, and the document of each.

    bounds: document i has values[bounds[i]:bounds[i + 1]].
    """
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h += mix(values[j : j + n] * _STEP[j])
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = doc[:n] == doc[k - 1 :]
    return mix(h)[inside], doc[:n][inside]


def fold(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of the whole sequence of each document; 0 for an empty one."""
    if not len(values):
        return np.zeros(len(bounds) - 1, np.uint64)
    place = np.arange(len(values)) - np.repeat(bounds[:-1], np.diff(bounds))
    x = mix(values ^ mix(place.astype(np.uint64) + np.uint64(77)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))
    return mix(total[bounds[1:]] - total[bounds[:-1]])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has at most `most` bytes of text, or one document."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
