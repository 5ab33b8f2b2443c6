"""Vectorised text primitives on Arrow buffers.

Whole columns are handled as one byte array with offsets, so the cost of a
batch is a few numpy passes over its bytes. White space is the six ASCII
characters of ``[\\x20\\x09-\\x0D]``; these bytes occur in no longer UTF-8
sequence, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are taken apart at once; temporaries are some hundred times as large at most.
SLICE_BYTES = 512 << 10
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * m)) - 1 for m in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes (or one row), to bound memory."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tidy(run):
    """``run`` of a mapInArrow, which gives memory back to the system after each batch.

    Arrow keeps what it has freed for later, as much as the largest batches
    took, and a worker that waits for its next task would hold it.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                del b
                pa.default_memory_pool().release_unused()

        yield from run(given())
        pa.default_memory_pool().release_unused()

    return tidied


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z only, as bytes."""
    return _LOWER[data]


#: Everything ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per row the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~sep[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = off[(off > 0) & (off < len(data))]
    begin[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number; zeros follow the end."""
    pad = np.zeros(len(data) + 8, np.uint8)
    pad[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", pad, strides=(1,))


def block(win: np.ndarray, starts: np.ndarray, sizes: np.ndarray, i: int) -> np.ndarray:
    """Bytes ``8 * i`` to ``8 * i + 7`` of each span as a number; zero beyond its end."""
    left = np.clip(sizes - 8 * i, 0, 8)
    return win[np.minimum(starts + 8 * i, len(win) - 1)] & _MASK[left]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span.

    A chain of finalisers over the length and the span's blocks of eight
    bytes: spans of one length that differ in a single block never collide,
    others like random numbers. Spans of more than ``_LONG`` bytes, of which
    a text can hold few, get a cryptographic digest.
    """
    sizes = ends - starts
    win = windows(data)
    out = mix(block(win, starts, sizes, 0) + sizes.astype(np.uint64) * _STEP)
    own = np.flatnonzero((sizes > 8) & (sizes <= _LONG))
    i = 1
    while len(own):
        out[own] = mix(out[own] * _STEP + block(win, starts[own], sizes[own], i))
        i += 1
        own = own[sizes[own] > 8 * i]
    for j in np.flatnonzero(sizes > _LONG).tolist():
        out[j] = int.from_bytes(hashlib.blake2b(data[starts[j] : ends[j]], digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, off: np.ndarray, sep: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and each row's first index."""
    data = lower(data)
    starts, ends, first = words(data, off, sep)
    return span_hashes(data, starts, ends), first


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles.

    A row of fewer than ``k`` words has its whole sequence as the only
    shingle; a row without words has the empty set.
    """
    rolled = hashes.copy()
    for i in range(1, min(k, len(hashes))):
        rolled[: len(hashes) - i] = rolled[: len(hashes) - i] * _STEP + hashes[i:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            s = np.sort(rolled[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            h = np.uint64(n)
            for w in hashes[a:b]:
                h = mix(np.array([h]) * _STEP + w)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
