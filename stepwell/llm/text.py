"""Vectorised word and line views of Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8
never splits a character.  All views work on the raw bytes of a whole batch,
so the cost is a few array passes and not a Python object per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; one longer text is one block.
BLOCK_BYTES = 300_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + _GOLD * np.uint64(2 * seed + 1))


def release_memory() -> None:
    """Gives back to the system what a worker's earlier tasks have freed but its allocators still hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@dataclass
class Words:
    """Words of a block of texts; ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.first))

    def heads(self, data: np.ndarray | None = None) -> np.ndarray:
        """The first eight bytes of each word as one little-endian number."""
        data = self.data if data is None else data
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))[self.start] & _KEEP[np.minimum(self.end - self.start, 8)]

    def hashes(self, data: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of ``data``, such as lower-cased ones).

        The length is mixed with the seed before any byte comes in: words that
        differ only by NUL bytes at the end get unrelated hashes, and two words
        that meet under one seed do not under another.
        """
        data = self.data if data is None else data
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        loads = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
        left = self.end - self.start
        h = seeded(left.astype(np.uint64), seed)
        at = self.start
        todo = None
        while len(left):
            part = mix((h if todo is None else h[todo]) ^ (loads[at] & _KEEP[np.minimum(left, 8)]))
            with np.errstate(over="ignore"):
                part *= _GOLD
            if todo is None:
                h = part
            else:
                h[todo] = part
            more = np.flatnonzero(left > 8)
            todo = more if todo is None else todo[more]
            at, left = at[more] + 8, left[more] - 8
        return mix(h)


def told_apart(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each item, first item of each key, key number of each item): items of one hash but different check get other keys."""
    key, first, back = np.unique(h, return_index=True, return_inverse=True)
    clash = check != check[first][back]
    if clash.any():
        return told_apart(np.where(clash, mix(h ^ check), h), check)
    return key, first, back


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> Words:
    """Maximal runs of the bytes that ``inside`` marks (default: all but white space), never across texts."""
    n = len(data)
    solid = (~SPACE if inside is None else inside)[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = solid[:-1]
        start = np.flatnonzero(solid & (~before | cut[:n]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = solid[1:]
        end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    else:
        start = end = np.zeros(0, np.int64)
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def count_in(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of ``marks`` are set in each text."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return np.diff(total[offsets])


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``block_bytes``."""
    data, offsets = texts_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + block_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingles(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of ``n`` words; a shorter text is one shingle of all its words."""
    count = np.diff(words.first)
    owner = words.text_of_word()
    if not len(hashes):
        return owner, hashes
    size = np.minimum(count, n)
    room = words.first[1:][owner] - np.arange(len(hashes))  # words from here to the text's end
    begins = room >= size[owner]
    at = np.flatnonzero(begins)
    length = size[owner[at]]
    h = length.astype(np.uint64)
    for k in range(n):
        on = np.flatnonzero(length > k)
        with np.errstate(over="ignore"):
            h[on] = mix(h[on] * _GOLD + hashes[at[on] + k])
    return owner[at], h
