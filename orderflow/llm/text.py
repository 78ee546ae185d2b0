"""Words, and fingerprints of words and of runs of words, for whole Arrow batches at a time.

A word is a maximal run of bytes outside space and 0x09-0x0D. Fingerprints have 64 bits. A word's takes eight bytes at
a time through a mixing step; that of a run of words is put together from those of runs half as long. Sums between
bounds (run_sums) are linear and serve only to find candidates that are then compared as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOL = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}
_STEP, _PAIR = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F)
_LONG = 512


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches again, in slices of about limit bytes of the column; one longer text is one slice."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        begin = 0
        while begin < len(size):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row begins; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and at which word each row begins."""
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    if len(data):
        before[offsets[:-1][offsets[:-1] < len(data)]] = True
        after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(str(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 1 << 23:
            _POWERS[str(base)] = known
    return known[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=sums[1:])
    return sums


def sums_between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    found = (sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, len(sums))[starts]
    return mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed polynomial sum of values[start:end] for each pair of bounds: equal for equal runs, and seldom for others."""
    return sums_between(prefix_sums(values), starts, ends)


def digest(data: np.ndarray, size: int = 8) -> bytes:
    return hashlib.blake2b(data.tobytes(), digest_size=size).digest()


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of data[start:end] for each pair of bounds; that of more than _LONG bytes is from its BLAKE2 digest."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _STEP)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    kept = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    at, done = np.flatnonzero((sizes > 0) & (sizes <= _LONG)), 0
    while len(at):
        left = sizes[at] - done
        out[at] = mix((out[at] ^ (eight[starts[at] + done] & kept[np.minimum(left, 8)])) * _STEP)
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(sizes > _LONG):
        out[i] = np.frombuffer(digest(data[starts[i] : ends[i]]), np.uint64)[0]
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of what a is of, followed by what b is of."""
    return mix(a * _PAIR + b)


def window_prints(words: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of each run of length words; runs that cross rows are the caller's to leave out."""
    n = max(0, len(words) - length + 1)
    out, done, size = np.full(n, length, np.uint64), 0, 1
    while n:
        if length & size:
            out = pair(out, words[done : done + n])
            done += size
        if 2 * size > length:
            break
        words, size = pair(words[:-size], words[size:]), 2 * size
    return out


def within(bounds: np.ndarray, length: int) -> np.ndarray:
    """Positions at which a run of length items lies within one row; bounds: the first item of each row, then the end."""
    sizes = np.maximum(np.diff(bounds) - length + 1, 0)
    return np.repeat(bounds[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
