"""Elias-Fano sequences over plain arrays, with vectorised access and successor search.

A non-decreasing sequence of n numbers below u keeps ``l = log2(u / n)`` low
bits of each number packed side by side, and the high parts as a bit vector
with a one for each number and a zero for each step of the high part: about
2 + l bits a number.  A directory holds the word of every 64th one and zero and
the ones before every word.  All arrays can be views of a memory-mapped file.
"""

from __future__ import annotations

import json

import numpy as np

_SAMPLE = 64
_U64 = np.uint64


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value side by side, little-endian, with eight spare bytes."""
    out = [np.zeros(0, np.uint8)]
    shifts = np.arange(width, dtype=np.uint64)
    step = 1 << 16  # whole bytes, whatever the width
    for i in range(0, len(values) if width else 0, step):
        bits = (values[i : i + step, None].astype(np.uint64) >> shifts) & _U64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


def unpack_bits(packed: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    bit = index.astype(np.int64) * width
    loads = np.ndarray(len(packed) - 7, "<u8", packed, 0, (1,))
    return (loads[bit >> 3] >> (bit & 7).astype(np.uint64)) & _U64((1 << width) - 1)


_L, _H = _U64(0x0101010101010101), _U64(0x8080808080808080)  # each byte's lowest, highest bit
_IN_BYTE = np.zeros((256, 8), np.uint8)  # place of the k-th one of a byte
for _bit in range(8):
    _of = np.flatnonzero(np.arange(256) >> _bit & 1)
    _IN_BYTE[_of, np.bitwise_count(_of & ((1 << _bit) - 1))] = _bit


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the ``rank``-th (from 0) one of each word: its byte by sums of ones up to each byte, then a table."""
    with np.errstate(over="ignore"):
        ones = word - ((word >> _U64(1)) & _U64(0x5555555555555555))
        ones = (ones & _U64(0x3333333333333333)) + ((ones >> _U64(2)) & _U64(0x3333333333333333))
        upto = ((ones + (ones >> _U64(4))) & _U64(0x0F0F0F0F0F0F0F0F)) * _L
        rank = rank.astype(np.uint64)
        at = np.bitwise_count(((rank * _L | _H) - upto) & _H).astype(np.uint64) << _U64(3)
        rank -= ((upto << _U64(8)) >> at) & _U64(255)
    return at.astype(np.int64) + _IN_BYTE[(word >> at) & _U64(255), rank]


class EliasFano:
    """``parts``: the arrays that ``encode`` made."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in parts["meta"])
        self.low, self.high, self.before, self.ones, self.zeros = (parts[k] for k in ("low", "high", "before", "ones", "zeros"))
        self.n_zeros = len(self.high) * 64 - self.n

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        width = min(56, max(0, int(np.floor(np.log2(max(1, universe) / max(1, n)))))) if n else 0
        values = values.astype(np.uint64)
        place = (values >> _U64(width)).astype(np.int64) + np.arange(n)
        size = (n + (int(universe) >> width) + 2 + 63) // 64 * 64
        bits = np.zeros(size, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1].astype("<u4" if n < 1 << 32 else "<u8")
        zero = np.flatnonzero(bits == 0)
        return {"meta": np.array([n, width], np.int64), "low": pack_bits(values, width), "high": high, "before": before, "ones": (place[::_SAMPLE] // 64).astype("<u4"), "zeros": (zero[::_SAMPLE] // 64).astype("<u4")}

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        sample = self.ones if one else self.zeros
        part, last = rank // _SAMPLE, len(sample) - 1
        upto = lambda w: self.before[w].astype(np.int64) if one else w * 64 - self.before[w].astype(np.int64)
        word = sample[part].astype(np.int64)
        end = np.where(part < last, sample[np.minimum(part + 1, last)], len(self.high) - 1).astype(np.int64)
        todo = np.flatnonzero(word < end)
        while len(todo):  # runs of the other bit can be long, so by halves
            middle = (word[todo] + end[todo] + 1) // 2
            after = upto(middle) > rank[todo]
            word[todo] = np.where(after, word[todo], middle)
            end[todo] = np.where(after, middle - 1, end[todo])
            todo = todo[word[todo] < end[todo]]
        bits = self.high[word] if one else ~self.high[word]
        return word * 64 + _select_in_word(bits, rank - upto(word))

    def get(self, index: np.ndarray) -> np.ndarray:
        """The numbers at ``index``."""
        index = index.astype(np.int64)
        return ((self._select(index, True) - index).astype(np.uint64) << _U64(self.width)) | unpack_bits(self.low, index, self.width)

    def get_two(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at ``index`` and at the places after it; the second one's bit is mostly close to the first one's."""
        index = index.astype(np.int64)
        bit = self._select(index, True)
        after = self._next(bit, True)
        far = np.flatnonzero(after < 0)
        after[far] = self._select(index[far] + 1, True)
        number = lambda b, i: ((b - i).astype(np.uint64) << _U64(self.width)) | unpack_bits(self.low, i, self.width)
        return number(bit, index), number(after, index + 1)

    def _next(self, bit: np.ndarray, one: bool) -> np.ndarray:
        """The next one (zero) after each bit where it lies in the same word of the bit after, else -1."""
        word = (bit + 1) >> 6
        bits = self.high[np.minimum(word, len(self.high) - 1)]
        bits = (bits if one else ~bits) >> ((bit + 1) & 63).astype(np.uint64)
        with np.errstate(over="ignore"):
            skip = np.bitwise_count(~bits & (bits - _U64(1)))  # 64 where no bit is left
        return np.where((skip < 64) & (word < len(self.high)), bit + 1 + skip, -1)

    def _of_high(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the first number whose high part is ``high`` or more, and more than ``high``."""
        high = np.minimum(high, self.n_zeros)
        zero = np.full(len(high), -1, np.int64)  # the zero that ends the numbers below
        some = np.flatnonzero(high > 0)
        zero[some] = self._select(high[some] - 1, False)
        after = self._next(zero, False)
        far = np.flatnonzero((after < 0) & (high < self.n_zeros))
        after[far] = self._select(high[far], False)
        first = zero - (high - 1)
        return first, np.where(high < self.n_zeros, after - high, first)

    def _search(self, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first number >= ``value`` in ``start:end``, or ``end``; whether it is ``value``)."""
        value = value.astype(np.uint64)
        high = (value >> _U64(self.width)).astype(np.int64)
        first, after = self._of_high(high)
        at, stop = np.clip(first, start, end), np.clip(after, start, end)
        same = stop.copy()
        low = value & _U64((1 << self.width) - 1)
        todo = np.flatnonzero(at < stop)
        while len(todo):  # a crowded range has many numbers of one high part, so by halves
            middle = (at[todo] + stop[todo]) // 2
            less = unpack_bits(self.low, middle, self.width) < low[todo]
            at[todo] = np.where(less, middle + 1, at[todo])
            stop[todo] = np.where(less, stop[todo], middle)
            todo = todo[at[todo] < stop[todo]]
        found = at < same  # of the same high part, so the low one decides
        on = np.flatnonzero(found)
        found[on] = unpack_bits(self.low, at[on], self.width) == low[on]
        return at, found

    def successor(self, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of the first number >= ``value`` in ``start:end``, or ``end``."""
        return self._search(value, start, end)[0]

    def find(self, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of ``value`` in ``start:end``, or -1."""
        at, found = self._search(value, start, end)
        return np.where(found, at, -1)


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays by name as one file: length of the header, header, arrays at multiples of eight."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, len(a), at]
        parts.append(raw + bytes(-len(raw) % 8))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def load(buffer: np.ndarray) -> dict[str, np.ndarray]:
    """Views of what ``dump`` wrote; ``buffer`` may be memory-mapped."""
    size = int.from_bytes(buffer[:8].tobytes(), "little")
    head = json.loads(buffer[8 : 8 + size].tobytes())
    return {name: np.ndarray(n, kind, buffer, 8 + size + at) for name, (kind, n, at) in head.items()}


def nested(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {k[len(prefix) + 1 :]: v for k, v in arrays.items() if k.startswith(prefix + ".")}
