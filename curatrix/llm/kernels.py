"""Vectorised text kernels over Arrow batches: documents as one byte buffer with offsets.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. UTF-8 continuation bytes are 0x80 and
up, so cutting bytes cuts the same words as cutting characters.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64


def lean(kernel):
    """The kernel of a mapInArrow; when its task is over, the worker, which lives on, gives freed memory back to the system."""

    @functools.wraps(kernel)
    def run(batches, *more):
        yield from kernel(batches, *more)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return run


BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The low k bytes of a 64-bit word.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
#: Bytes from which a range is hashed by BLAKE2, one by one.
_LONG = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


#: Bytes between tokens of letters: all of ASCII but its letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end bytes of all words, and each document's first word; words never cross documents."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ink = ~gap[buf]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = ink[at]
    at = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[at] = ink[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words_of_eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on as one little-endian word; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges [starts, ends): each word of eight bytes is mixed into all bits before the next."""
    size = ends - starts
    out = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U(0xD6E8FEB86659FD93 ^ salt))
    if not len(out):
        return out
    wide = words_of_eight(buf)
    live = None
    if size.max() > _LONG:
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = int.from_bytes(blake2b(buf[starts[i] : ends[i]], digest_size=8, key=bytes([salt])).digest(), "little")
        live = np.flatnonzero(size <= _LONG)
        starts, size = starts[live], size[live]
    while len(starts):
        word = wide[starts] & _LOW[np.minimum(size, 8)]
        if live is None:
            out = mix(out ^ word)
            live = np.flatnonzero(size > 8)
            starts, size = starts[live] + 8, size[live] - 8
        else:
            out[live] = mix(out[live] ^ word)
            on = np.flatnonzero(size > 8)
            live, starts, size = live[on], starts[on] + 8, size[on] - 8
    return out


def same_bytes(buf: np.ndarray, starts: np.ndarray, size: np.ndarray, other: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each range of buf holds the bytes at `others` in other; the ranges there are as long."""
    out = np.ones(len(starts), bool)
    x, y = words_of_eight(buf), words_of_eight(other)
    live = np.arange(len(starts))
    while len(live):
        out[live] &= ((x[starts] ^ y[others]) & _LOW[np.minimum(size, 8)]) == 0
        on = np.flatnonzero(size > 8)
        live, starts, others, size = live[on], starts[on] + 8, others[on] + 8, size[on] - 8
    return out


def char_counts(buf: np.ndarray) -> np.ndarray:
    """Running number of code points: entry i counts those that start before byte i."""
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=total[1:])
    return total


def by_doc(first_word: np.ndarray, n: int) -> np.ndarray:
    """The document of each of n words."""
    return np.repeat(np.arange(len(first_word) - 1), np.diff(first_word)) if n else np.zeros(0, np.int64)


def add_up(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive entries of first."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def look_up(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key is in the ascending table; -1 where it isn't."""
    if not len(table) or not len(keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)
