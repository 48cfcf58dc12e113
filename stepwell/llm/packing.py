"""Hierarchical packing of documents into sequences of several lengths.

Tiers are powers of two up to the longest context.  A document's tokens are its
ids and one end id.  Whole contexts are cut off a document longer than the
longest tier; what remains is routed to the smallest tier that holds it.  From
the longest tier down, each window starts with the longest piece of its tier and
its gap is filled from the shorter tiers, always with the longest piece that
fits; only where none fits is the shortest one cut, to fill the gap exactly.  So
every window is full.  Pieces too few for a window wait for more documents; the
last ones of a partition go into windows of the powers of two that add up to
them, which need no padding either.

Windows of a tier are dealt into step groups of STEP_TOKENS tokens each, in turn
by attention work (the sum of squared piece lengths), so the steps of a group
take alike long.  Windows too few for a group wait for the next batch; only the
last group of a tier in a partition may be smaller.

Each partition packs on its own in one pass: no shuffle, no group to gather, and
memory bounded by BUFFER_TOKENS and the longest document.  Window and group
numbers carry the partition's number.  Pieces of one length are taken in the
order of arrival, so the same rows in the same order are packed alike, and a lost
task packs its partition as before.

Defined cases: a null or empty text is its end id alone; a very long text is cut
into whole windows; repeated rows are packed each; an empty table has no piece;
tokens of other columns do not exist, whatever their names.
"""

from __future__ import annotations

import os
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hash_table import Table
from .staging import small_batches
from .text import blocks, release_memory, told_apart, words_of

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 32_768
BUFFER_TOKENS = 500_000
END_ID = 1
CACHED_WORDS = 500_000
BLOCK_BYTES = 500_000


class WordTokens:
    """Ids of texts by a library tokenizer that never joins words across ASCII white space.

    Words are remembered by two 64-bit hashes; the library turns the new ones of
    a block of texts into ids in few calls.  More than CACHED_WORDS start it over.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.table = Table()
        self.check = np.zeros(0, np.uint64)
        self.start = np.zeros(1, np.int64)  # of each word's ids, and the end of all
        self.ids = np.zeros(0, "<u4")

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block, where each text's begin and the end of all)."""
        words = words_of(data, offsets)
        check = words.hashes(seed=1 << 40)
        key, first, back = told_apart(words.hashes(), check)
        if len(self.check) + len(key) > CACHED_WORDS:
            self._forget()
        at = self.table.find(key)
        fresh = at < 0
        new = np.flatnonzero(fresh | (self.check[at] != check[first]) if len(self.check) else fresh)
        if len(new):
            raw, start, end = data.tobytes(), words.start[first[new]].tolist(), words.end[first[new]].tolist()
            ids, sizes = self._encode([raw[a:b].decode("utf-8") for a, b in zip(start, end)])
            at[new] = len(self.check) + np.arange(len(new))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.ids, self.check = np.concatenate([self.ids, ids]), np.concatenate([self.check, check[first[new]]])
            put = new[fresh[new]]
            self.table.put(key[put], at[put])
        at = at[back]
        size = self.start[at + 1] - self.start[at]
        edge = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.start[at] - edge[:-1], size) + np.arange(edge[-1])
        return self.ids[place], edge[words.first]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has): one call over some thousand, told apart by where tokens begin."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for some in batched(words, 8192):
            found = self.library.encode(" ".join(some), add_special_tokens=False)
            ids.append(np.array(found.ids, "<u4"))
            begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids[-1]))
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            sizes.append(np.diff(np.searchsorted(begins, ends), prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


class Packer:
    """Packs documents of one partition.  A waiting piece is (length, start, number of arrival, document)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, first_window: int = 0, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.pools: dict[int, list] = {t: [] for t in tiers}
        self.waiting = 0
        self.window = self.group = first_window
        self.done: dict[int, list] = {}
        self.arrived = 0

    def add(self, document, length: int) -> None:
        start, top = 0, self.tiers[0]
        self.arrived += 1
        while length - start >= top:
            self._close(top, [(top, document, start)])
            start += top
        if length > start:
            self._pool(length - start, self.arrived, document, start)

    def _pool(self, length: int, arrival: int, document, start: int) -> None:
        tier = min(t for t in self.tiers if t >= length)
        insort(self.pools[tier], (length, start, arrival, document), key=lambda x: x[:3])
        self.waiting += length

    def _take(self, room: int, tiers: tuple[int, ...]):
        """The longest piece that fits, from the first tier that has one."""
        for t in tiers:
            pool = self.pools[t]
            if k := bisect_right(pool, room, key=lambda x: x[0]):
                length, start, _, document = pool.pop(k - 1)
                self.waiting -= length
                return length, document, start
        return None

    def _cut(self, room: int):
        """``room`` tokens of the shortest piece; the rest of it waits."""
        for t in reversed(self.tiers):
            if self.pools[t]:
                length, start, arrival, document = self.pools[t].pop(0)
                self.waiting -= length
                self._pool(length - room, arrival, document, start + room)
                return room, document, start
        raise ValueError("no piece left")

    def _fill(self, size: int) -> None:
        pieces, room = [], size
        tiers = tuple(t for t in self.tiers if t <= size)
        while room:
            piece = self._take(room, tiers) or self._cut(room)
            pieces.append(piece)
            room -= piece[0]
        self._close(size, pieces)

    def _close(self, size: int, pieces: list) -> None:
        self.done.setdefault(size, []).append(pieces)

    def pack(self, final: bool = False) -> None:
        for tier in self.tiers:
            while self.pools[tier] and self.waiting >= tier:
                self._fill(tier)
        if final:
            for bit in reversed(range(self.tiers[0].bit_length())):
                while self.waiting >= 1 << bit:
                    self._fill_any(1 << bit)

    def _fill_any(self, size: int) -> None:
        pieces, room = [], size
        while room:
            piece = self._take(room, self.tiers) or self._cut(room)
            pieces.append(piece)
            room -= piece[0]
        self._close(size, pieces)

    def drain(self, final: bool = True) -> Iterator[tuple[int, int, int, list]]:
        """(window, tier, step group, pieces) of the closed windows; unless ``final``, those too few for a group wait."""
        waiting = {}
        for size in sorted(self.done, reverse=True):
            each = max(1, self.step_tokens // size)
            whole = len(self.done[size]) // each * each
            waiting[size] = self.done[size][whole:]
            parts = [self.done[size][:whole], waiting.pop(size) if final else []]
            for part in filter(None, parts):
                groups = -(-len(part) // each)
                for k, pieces in enumerate(sorted(part, key=lambda w: -sum(p[0] ** 2 for p in w))):
                    turn, place = divmod(k, groups)
                    yield self.window, size, self.group + (place if turn % 2 == 0 else groups - 1 - place), pieces
                    self.window += 1
                self.group += groups
        self.done = {size: own for size, own in waiting.items() if own}


def pack_documents(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: ``keep``, start, length, ids (binary), doc_tokens, sequence_id, offset, tier, step_group."""
    end = np.array([END_ID], "<u4").tobytes()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, context = word_tokens(tokenizer_path), TaskContext.get()
        release_memory()
        packer = Packer(tiers, (context.partitionId() if context else 0) << 36)
        schema = None

        def rows(final: bool) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in range(8 + len(keep))]
            for window, tier, group, pieces in packer.drain(final):
                offset = 0
                for length, document, start in pieces:
                    ids, total, own = document
                    for column, value in zip(out, (*own, start, length, ids[4 * start : 4 * (start + length)], total, window, offset, tier, group)):
                        column.append(value)
                    offset += length
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

        for batch in batches:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            schema = pa.schema([*((f"k{k}", batch.schema.types[k + 1]) for k in range(len(keep))), *zip(names, kinds)])
            own = list(zip(*(batch.column(k + 1).to_pylist() for k in range(len(keep)))))
            for i, j, data, offsets in blocks(batch.column(0), BLOCK_BYTES):
                every, edge = tokens(data, offsets)
                for k, (a, b) in enumerate(zip(edge, edge[1:]), i):
                    ids = every[a:b].tobytes() + end
                    packer.add((ids, len(ids) // 4, own[k]), len(ids) // 4)
                    if packer.waiting + sum(len(w) * t for t, w in packer.done.items()) > BUFFER_TOKENS:
                        packer.pack()
                        yield from rows(False)
        packer.pack(final=True)
        if schema is not None:
            yield from rows(True)

    picked = docs.select(F.col(text).alias("text"), *(F.col(k).alias(f"k{n}") for n, k in enumerate(keep)))
    kept = ", ".join(f"k{n} {picked.schema[n + 1].dataType.simpleString()}" for n in range(len(keep)))
    schema = f"{kept}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
    return picked.mapInArrow(run, schema).withColumnsRenamed({f"k{n}": k for n, k in enumerate(keep)})
