"""Whole-batch text arithmetic: numpy over the Arrow buffers of a task.

A task sees a batch of texts as one byte array with row offsets. Hashes of
all words, shingles or byte windows come from prefix sums of a polynomial
modulo 2**64, so no Python loop runs per word. Memory is bounded by
``SLICE_BYTES`` of text at a time (a longer single text is its own slice).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (splitmix64), elementwise."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = [mix(np.arange(256, dtype=U), s + 11) for s in range(2)]
_BASE = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, at least ``n`` of each."""
    have = _POW.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 64)
        base = _BASE[which]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POW[which] = have = (both[0], both[1])
    return have


class Spans:
    """Hash of any span of a value sequence in constant time."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        power, self.inverse = powers(n + 1, which)
        self.sums = np.empty(n + 1, U)
        self.sums[0] = 0
        np.cumsum(values * power[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, U)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def byte_spans(data: np.ndarray, which: int = 0) -> Spans:
    return Spans(_BYTE[which][data], which)


def slices(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches at row bounds so that each holds about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the row offsets; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None or data is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


#: Spaces of the word rule: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-casing of A-Z alone; other bytes of UTF-8 never fall into this range.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, off)


def inside_rows(off: np.ndarray, length: int) -> np.ndarray:
    """Starts of all spans of ``length`` units that stay within one row."""
    n = int(off[-1])
    ok = np.zeros(n + 1, np.int64)
    size = np.diff(off)
    rows = size >= length
    np.add.at(ok, off[:-1][rows], 1)
    np.add.at(ok, off[1:][rows] - length + 1, -1)
    return np.flatnonzero(np.cumsum(ok)[:n] > 0)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window of ``width`` values, by window start."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def runs(values: np.ndarray) -> np.ndarray:
    """Start of every run of equal neighbours."""
    if not len(values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]])


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the units that any of the spans covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0


def ids(col: pa.Array) -> np.ndarray:
    """Integer ids as an array; null as 0, for rows that aren't used."""
    return pc.fill_null(col, 0).to_numpy(zero_copy_only=False)
