"""Phrase collocations: candidates by sketch, exact counts by automata, then thresholds.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and
pieces into words.  A phrase is two to MAX_WORDS words of one piece; everything is
counted per language.

1. Sketch.  A phrase belongs to a cell, chosen by a hash of its words and language
   among CELLS_PER_BYTE cells for each byte of text, so cells stay as sparse as
   texts grow.  Tasks add up cells and send them on as compressed runs, one per
   range of cells; a range is added up in one small array.  The count of a cell is
   an upper bound of the count of each phrase in it.
2. Candidates and windows.  Cells of MIN_COUNT or more go into a Bloom filter of
   fixed size.  A second pass over the texts gives the distinct phrases that pass
   it, sent as compressed runs of a range of cells; where the runs of a range meet,
   its heavy cells drop what the filter let through by chance.  No phrase of
   MIN_COUNT occurrences is lost.  The same pass gives, for each place of a text,
   its window: the longest phrase that begins there and passes the filter, so that
   every candidate that begins there begins the window; and, beside it, the word
   there.  A task sends each distinct window once, with its number of places.
3. Automata.  Windows and candidates (with the first and last word of each) are
   dealt by a hash of their first two words over shards, one for each
   SHARD_TEXT_BYTES of text.  A shard's patterns are compiled into pyahocorasick
   automata of at most BLOCK_PATTERN_BYTES, one for each language; patterns carry a
   blank at both ends, and so do the words of the windows, so only whole words
   match, and a window ends with a line break that no pattern has.  Matches at the
   beginning of a window, times its number of places, sum to exact counts: a
   pattern's occurrences all lie in its own shard, so texts are read no more often
   however many patterns there are.
4. Thresholds, scores, containment and ranks by joins and windows.

A word of more than LONG_WORD bytes stands in patterns and windows as a digest of
it, so that a pattern has a bounded length.

Defined cases: null and empty texts have no words; a null language is ``und``, and
so is one of that name; very long texts are read whole; repeated rows count each
time; ties rank by count, then by the phrase's bytes; an empty table gives an
empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
import operator
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hash_table import Table
from .id_filter import IdFilter, in_filter
from .staging import small_batches, stage
from .text import LOWER, Words, blocks, mix, release_memory, texts_of, told_apart, words_of

MAX_WORDS = 4
MIN_COUNT = 30
#: A candidate inside a longer one with at least this percentage of its count is dropped.
INSIDE_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
NO_LANG = "und"

#: Width of the sketch; any width gives the same result, a smaller one more phrases to count exactly.
CELLS_PER_BYTE = 2
RANGE_BITS = 24
GATHER = 4_000_000
FILTER_BITS = 26
BLOCK_PATTERN_BYTES = 6 << 20
SHARD_TEXT_BYTES = 16 << 20
#: So many distinct windows are held by a task before they are sent.
WINDOWS = 1_000_000
BLOCK_TEXT_BYTES = 2_000_000
LONG_WORD = 64
RANK_BUCKETS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MARK = 1  # the byte that a digest begins with


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, lower-cased bytes, offsets) of blocks of texts, from batches of (lang, text)."""
    for batch in batches:
        lang, text = batch.column(0), batch.column(1)
        for own in pc.unique(lang).to_pylist():
            for _, _, data, offsets in blocks(text.filter(pc.equal(lang, own)), BLOCK_TEXT_BYTES):
                yield own, LOWER[data], offsets


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words, and the number of the piece that each is in."""
    words = words_of(data, offsets, _INSIDE)
    return words, np.cumsum(_BREAK[data])[words.start] + words.text_of_word() if len(words.start) else np.zeros(0, np.int64)


def _phrases(lang: str, hashes: np.ndarray, piece: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of words, first words, hashes) of the words and of the phrases of two words and more."""
    seed = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
    h = mix(hashes ^ np.uint64(seed))
    yield 1, np.arange(len(h)), h
    for n in range(2, MAX_WORDS + 1):
        m = len(hashes) - n + 1
        if m <= 0:
            return
        with np.errstate(over="ignore"):
            h = mix(h[:m] * _GOLD + hashes[n - 1 :])
        at = np.flatnonzero(piece[:m] == piece[n - 1 :])
        yield n, at, h[at]


def _packed(cells: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted cells of a range as differences, and their counts, byte by byte, compressed."""
    planes = np.stack([np.diff(cells, prepend=0), n]).astype("<u4").view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)
    return pa.compress(pa.py_buffer(np.ascontiguousarray(planes)), codec="zstd", asbytes=True)


def _unpacked(content: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(content, 8 * size, codec="zstd"), np.uint8).reshape(2, 4, size)
    gap, n = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)
    return np.cumsum(gap), n


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def sketch_bits(n_bytes: int) -> int:
    """The sketch of texts of so many bytes has two to the power of this cells, one range at least."""
    return max(RANGE_BITS, (CELLS_PER_BYTE * max(1, n_bytes) - 1).bit_length())


def sketch_runs(spark: SparkSession, texts: DataFrame, bits: int) -> DataFrame:
    """Rows (range, size, run) of cells added up in a task, and (lang, size), the words of a language in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held, n_words = 0, collections.Counter()

        def rows(where: list, lang: list, size: list, runs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(lang, pa.string()), pa.array(size, pa.int64()), pa.array(runs, pa.binary())], names=["range", "lang", "size", "run"])

        def packed() -> pa.RecordBatch:
            cell = np.concatenate(held)
            cell.sort()
            at = np.flatnonzero(np.diff(cell, prepend=cell[:1] ^ np.uint64(1)))
            n, cell = np.diff(at, append=len(cell)), cell[at].astype(np.int64)
            where = cell >> RANGE_BITS
            edges = np.flatnonzero(np.diff(where, prepend=-1, append=-1))
            low = cell & ((1 << RANGE_BITS) - 1)
            parts = [(int(where[a]), int(b - a), _packed(low[a:b], n[a:b])) for a, b in zip(edges, edges[1:])]
            return rows([p[0] for p in parts], [None] * len(parts), [p[1] for p in parts], [p[2] for p in parts])

        for lang, data, offsets in _by_lang(batches):
            words, piece = _pieces(data, offsets)
            n_words[lang] += len(words.start)
            for _, _, h in _phrases(lang, words.hashes(), piece):
                held.append(h >> np.uint64(64 - bits))
                n_held += len(h)
            if n_held >= GATHER:
                yield packed()
                held, n_held = [], 0
        if n_held:
            yield packed()
        yield rows([None] * len(n_words), list(n_words), list(n_words.values()), [None] * len(n_words))
        held = []
        release_memory()

    return stage(spark, texts.mapInArrow(run, "range long, lang string, size long, run binary"), "sketch-runs")


def heavy_cells(spark: SparkSession, runs: DataFrame, min_count: int) -> DataFrame:
    """(cell) of the cells that hold ``min_count`` words and phrases or more."""

    def add(key: tuple, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RANGE_BITS, np.int32)
        for piece in pieces:
            for size, content in zip(piece.column(1).to_pylist(), piece.column(2)):
                cells, n = _unpacked(content.as_buffer(), size)
                total[cells] = np.minimum(total[cells] + n, min_count)  # a run has a cell once, and more does not matter
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total >= min_count) + (key[0].as_py() << RANGE_BITS), pa.int64())], names=["cell"])

    return stage(spark, runs.where("range is not null").select("range", "size", "run").groupBy("range").applyInArrow(add, "cell long"), "heavy-cells")


def _token(word: bytes) -> bytes:
    """A word as patterns have it: itself, or a digest if it is long or begins like a digest."""
    return word if len(word) <= LONG_WORD and word[:1] != bytes([_MARK]) else bytes([_MARK]) + hashlib.blake2b(word, digest_size=20).hexdigest().encode()


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of each stretch, each followed by a line break."""
    length = end - begin
    to = np.cumsum(length + 1) - length - 1
    out = np.full(int(length.sum()) + len(length), 0x0A, np.uint8)
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + step] = data[np.repeat(begin, length) + step]
    return out


def _lines(words: Words, data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, bytes, dict[bytes, bytes]]:
    """(order, patterns by line, phrases of the patterns that differ from theirs) of phrases of ``n`` words; lines are in that order of them."""
    size = words.end - words.start
    plain = (size <= LONG_WORD) & (data[words.start] != _MARK)
    tied = np.zeros(len(size), bool)  # a blank alone follows, and then the next word
    tied[:-1] = (words.start[1:] - words.end[:-1] == 1) & (data[words.end[:-1]] == 0x20)
    easy = plain[at]
    for k in range(1, MAX_WORDS):
        on = np.flatnonzero(n > k)
        easy[on] &= tied[at[on] + k - 1] & plain[at[on] + k]
    lines, odd = [_slices(data, words.start[at[easy]], words.end[at[easy] + n[easy] - 1]).tobytes()], {}
    for i, m in zip(at[~easy], n[~easy]):
        own = [data[a:b].tobytes() for a, b in zip(words.start[i : i + m], words.end[i : i + m])]
        phrase, pattern = b" ".join(own), b" ".join(map(_token, own))
        lines.append(pattern + b"\n")
        if phrase != pattern:
            odd[pattern] = phrase
    return np.append(np.flatnonzero(easy), np.flatnonzero(~easy)), b"".join(lines), odd


@dataclass
class Found:
    """Phrases of a language that a task has found in heavy cells: cells, patterns and, where they differ, phrases."""

    cells: list[np.ndarray] = field(default_factory=list)
    lines: list[bytes] = field(default_factory=list)
    odd: dict[bytes, bytes] = field(default_factory=dict)

    def add(self, words: Words, data: np.ndarray, at: np.ndarray, n: int, cells: np.ndarray) -> None:
        order, lines, odd = _lines(words, data, at, np.full(len(at), n))
        self.cells.append(cells[order])
        self.lines.append(lines)
        self.odd.update(odd)

    def runs(self, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(range, run, odd) of the phrases of each range of two to the power of ``bits`` cells: a run is (size, cells in the range, patterns)."""
        cells = np.concatenate(self.cells)
        patterns_ = pa.array(b"".join(self.lines).split(b"\n")[:-1], pa.binary())
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        where = cells >> bits
        edges = np.flatnonzero(np.diff(where, prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:]):
            own = patterns_.take(pa.array(order[a:b])).to_pylist()
            low = (cells[a:b] & ((1 << bits) - 1)).astype("<u4").tobytes()
            odd = [x for pattern in own if pattern in self.odd for x in (pattern, self.odd[pattern])]
            yield int(where[a]), pickle.dumps((b - a, pa.compress(low + b"\n".join(own), codec="zstd", asbytes=True), 4 * (b - a) + sum(map(len, own)) + b - a - 1)), b"\n".join(odd)


def shards_of(data: np.ndarray, offsets: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each line of tokens, by its first two or its only one."""
    words = words_of(data, offsets, _INSIDE)
    h = words.hashes(seed=1 << 41)
    first, two = words.first[:-1], np.diff(words.first) > 1
    out = h[first]
    with np.errstate(over="ignore"):
        out[two] = mix(out[two] * _GOLD + h[first[two] + 1])
    return (out % np.uint64(n_shards)).astype(np.int64)


class Windows:
    """Distinct windows of a language that a task has found, and in how many places."""

    def __init__(self):
        self.known = Table()  # hash of a window to its number
        self.n = self.check = np.zeros(0, np.uint64)
        self.lines: list[bytes] = []
        self.size = 0

    def add(self, words: Words, data: np.ndarray, at: np.ndarray, n: np.ndarray, h: np.ndarray, check: np.ndarray) -> None:
        key, first, back = told_apart(h, check)
        times = np.bincount(back, minlength=len(key)).astype(np.uint64)
        slot = self.known.find(key)
        same = slot >= 0
        same[same] = self.check[slot[same]] == check[first[same]]
        self.n[slot[same]] += times[same]
        new = np.flatnonzero(~same)
        order, lines, _ = _lines(words, data, at[first[new]], n[first[new]])
        new = new[order]
        numbers = np.arange(self.size, self.size + len(new))
        if self.size + len(new) > len(self.n):
            room = np.zeros(max(len(self.n), len(new)), np.uint64)
            self.n, self.check = np.append(self.n, room), np.append(self.check, room)
        self.n[numbers], self.check[numbers] = times[new], check[first[new]]
        free = slot[new] < 0  # a window whose hash another one has is a line of its own each time
        self.known.put(key[new[free]], numbers[free])
        self.lines.append(lines)
        self.size += len(new)

    def runs(self, n_shards: int) -> Iterator[tuple[int, bytes]]:
        """(shard, run): a run is its size, its length and, compressed, numbers of places and guarded lines."""
        data = np.frombuffer(b"".join(self.lines), np.uint8)
        offsets = np.append(0, np.flatnonzero(data == 0x0A) + 1)
        shard = shards_of(data, offsets, n_shards)
        text = (b" " + data.tobytes().replace(b"\n", b" \n "))[:-1]
        lines = pa.Array.from_buffers(pa.large_binary(), self.size, [None, pa.py_buffer(offsets + 2 * np.arange(self.size + 1)), pa.py_buffer(text)])
        order = np.argsort(shard, kind="stable")
        data, offsets = texts_of(lines.take(pa.array(order)))
        n = self.n[order]
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:]):
            plain = n[a:b].tobytes() + data[offsets[a] : offsets[b]].tobytes()
            yield int(shard[order[a]]), pickle.dumps((int(b - a), len(plain), pa.compress(plain, codec="zstd", asbytes=True)))


def found_in_heavy_cells(spark: SparkSession, texts: DataFrame, heavy: DataFrame, bits: int, n_shards: int) -> DataFrame:
    """Runs of the phrases in heavy cells (by range) and of the windows (by shard) that tasks find, one for each language."""
    cells = IdFilter(heavy, "cell", FILTER_BITS)
    shared = cells.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def none() -> tuple:
            return Table(), collections.defaultdict(Found), collections.defaultdict(Windows)

        def rows(where: str, lang: str, runs: list) -> pa.RecordBatch:
            own = pa.array([r[0] for r in runs], pa.int64())
            no = pa.nulls(len(runs), pa.int64())
            odd = pa.array([r[2] if len(r) > 2 else None for r in runs], pa.binary())
            return pa.RecordBatch.from_arrays([own if where == "range" else no, own if where == "shard" else no, pa.array([lang] * len(runs)), pa.array([r[1] for r in runs], pa.binary()), odd], names=["range", "shard", "lang", "run", "odd"])

        def given() -> Iterator[pa.RecordBatch]:
            for lang, own in found.items():
                yield rows("range", lang, list(own.runs(RANGE_BITS)))
            for lang, own in windows.items():
                yield rows("shard", lang, list(own.runs(n_shards)))

        seen, found, windows = none()  # seen: hash of a phrase to a second hash; one that has both was given before
        for lang, data, offsets in _by_lang(batches):
            words, piece = _pieces(data, offsets)
            first, second = (list(_phrases(lang, words.hashes(seed=s), piece)) for s in (0, 1 << 40))
            size = np.zeros(len(words.start), np.int64)
            longest = np.zeros((2, len(size)), np.uint64)
            for (n, at, h), (_, _, check) in zip(first, second):
                cell = (h >> np.uint64(64 - bits)).astype(np.int64)
                on = np.flatnonzero(in_filter(shared.value, cell))
                if n == 1:
                    if len(on):
                        windows[lang].add(words, data, on, np.ones(len(on), np.int64), h[on], check[on])
                    continue
                size[at[on]], longest[:, at[on]] = n, (h[on], check[on])
                order = on[np.lexsort((check[on], h[on]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
                on = order[new]
                mark = (check[on] >> np.uint64(1)).astype(np.int64)
                known = seen.find(h[on])
                fresh = np.flatnonzero(known < 0)
                fresh = fresh[np.unique(h[on[fresh]], return_index=True)[1]]
                seen.put(h[on[fresh]], mark[fresh])
                on = on[known != mark]
                if len(on):
                    found[lang].add(words, data, at[on], n, cell[on])
            at = np.flatnonzero(size)
            if len(at):
                windows[lang].add(words, data, at, size[at], longest[0, at], longest[1, at])
            if sum(w.size for w in windows.values()) >= WINDOWS:
                yield from given()
                seen, found, windows = none()
        yield from given()
        seen = found = windows = None
        release_memory()

    out = stage(spark, texts.mapInArrow(run, "range long, shard long, lang string, run binary, odd binary"), "found")
    cells.destroy()
    return out


def candidates(spark: SparkSession, found: DataFrame, heavy: DataFrame) -> DataFrame:
    """(lang, pattern, phrase) of the distinct phrases in heavy cells; phrase is null where it is the pattern.

    A range's runs meet its heavy cells and become one set.
    """

    def merge(key: tuple, runs: pa.Table, own: pa.Table) -> pa.Table:
        full = np.zeros(1 << RANGE_BITS, bool)
        full[own["cell"].to_numpy() & ((1 << RANGE_BITS) - 1)] = True
        every: dict[str, set[bytes]] = collections.defaultdict(set)
        phrases: dict[tuple[str, bytes], bytes] = {}
        for row in runs.to_pylist():
            size, content, length = pickle.loads(row["run"])
            plain = pa.decompress(content, length, codec="zstd", asbytes=True)
            on = full[np.frombuffer(plain[: 4 * size], "<u4")]
            every[row["lang"]].update(itertools.compress(plain[4 * size :].split(b"\n"), on.tolist()))
            odd = row["odd"].split(b"\n") if row["odd"] else []
            phrases.update({(row["lang"], p): x for p, x in zip(odd[::2], odd[1::2])})
        lang = [x for x, own_ in every.items() for _ in own_]
        pattern = [p for own_ in every.values() for p in own_]
        phrase = [phrases.get(x) for x in zip(lang, pattern)]
        return pa.table({"lang": pa.array(lang, pa.string()), "pattern": pa.array(pattern, pa.binary()).cast(pa.string()), "phrase": pa.array(phrase, pa.binary()).cast(pa.string())})

    runs = found.where("range is not null").select("range", "lang", "run", "odd").groupBy("range")
    full = heavy.select(F.shiftright("cell", RANGE_BITS).alias("range"), "cell").groupBy("range")
    return stage(spark, runs.cogroup(full).applyInArrow(merge, "lang string, pattern string, phrase string"), "candidates")


def patterns(found: DataFrame, n_shards: int) -> DataFrame:
    """(shard, lang, pattern, phrase, n_words): the candidates and the words at their ends."""
    words = F.split("pattern", " ")
    ends = found.select("lang", F.explode(F.array(F.get(words, F.lit(0)), F.element_at(words, -1))).alias("pattern")).distinct()
    every = found.select("lang", "pattern", "phrase", F.size(words).alias("n_words")).unionByName(ends.select("lang", "pattern", F.lit(None).cast("string").alias("phrase"), F.lit(1).alias("n_words")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shards_of(*texts_of(batch.column("pattern")), n_shards) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", *batch.schema.names])

    return every.mapInArrow(deal, "shard long, lang string, pattern string, phrase string, n_words int")


def guarded(data: np.ndarray, offsets: np.ndarray) -> str:
    """Texts for an automaton: a blank before each word and after the last of a piece, then a line break."""
    words, piece = _pieces(data, offsets)
    if not len(words.start):
        return ""
    size = words.end - words.start
    odd = np.flatnonzero((size > LONG_WORD) | (data[words.start] == _MARK))
    tokens = [_token(data[words.start[k] : words.end[k]].tobytes()) for k in odd]
    size[odd] = [len(x) for x in tokens]
    last = np.append(np.flatnonzero(np.diff(piece)), len(piece) - 1)
    room = size + 1
    room[last] += 2
    to = np.cumsum(room) - room + 1  # where a word's bytes begin
    out = np.full(int(room.sum()), 0x20, np.uint8)
    out[to[last] + size[last] + 1] = 0x0A
    plain = np.ones(len(size), bool)
    plain[odd] = False
    length = size[plain]
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to[plain], length) + step] = data[np.repeat(words.start[plain], length) + step]
    for k, token in zip(odd, tokens):
        out[to[k] : to[k] + len(token)] = np.frombuffer(token, np.uint8)
    return out.tobytes().decode()


_compiled: tuple[str, dict] = ("", {})


def automata(key: str, block: dict[str, tuple[np.ndarray, str]]) -> dict[str, ahocorasick.Automaton]:
    """An automaton for each language of a block (ids, patterns by line), kept by a worker until the next block."""
    global _compiled
    if _compiled[0] != key:
        _compiled = ("", {})
        made = {}
        for lang, (_, lines) in block.items():
            made[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, pattern in enumerate(lines.split("\n")):
                made[lang].add_word(f" {pattern} ", k)
            made[lang].make_automaton()
        _compiled = (key, made)
    return _compiled[1]


def matches(automaton: ahocorasick.Automaton, text: str) -> collections.Counter:
    """How often each pattern occurs in a guarded text, overlapping matches included."""
    return collections.Counter(map(operator.itemgetter(1), automaton.iter(text)))


def beginnings(automaton: ahocorasick.Automaton, length: np.ndarray, one: np.ndarray, lines: pa.Array, times: np.ndarray) -> np.ndarray:
    """How often each pattern begins a guarded line (or, of one word, is it), each line counted ``times``.

    length: code points of each pattern; one: which of them have one word.
    """
    size = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    f = np.zeros(len(length), np.int64)
    a, most = 0, BLOCK_TEXT_BYTES
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + most)))
        data, offsets = texts_of(lines.slice(a, b - a))
        found = np.fromiter(itertools.chain.from_iterable(automaton.iter(data.tobytes().decode())), np.int64).reshape(-1, 2)
        end, k = found[:, 0] + begin[a], found[:, 1]
        start = end - length[k] - 1
        line = np.searchsorted(begin[a:b], start, "right") - 1 + a
        on = (begin[line] == start) & (~one[k] | (size[line] == length[k] + 3))
        np.add.at(f, k[on], times[line[on]])
        a = b
    return f


def pattern_counts(spark: SparkSession, found: DataFrame, listed: DataFrame) -> DataFrame:
    """(lang, pattern, phrase, n_words, f) of every pattern that occurs: where a shard's windows meet its patterns."""

    def count(key: tuple, runs: pa.Table, own: pa.Table) -> pa.Table:
        f = np.zeros(len(own), np.int64)
        for lang in pc.unique(own["lang"]).to_pylist():
            held: list[tuple[np.ndarray, pa.Array]] = []
            for run in runs.filter(pc.equal(runs["lang"], lang))["run"].to_pylist():
                size, length, content = pickle.loads(run)
                plain = np.frombuffer(pa.decompress(content, length, codec="zstd"), np.uint8)
                text = plain[8 * size :]
                ends = np.append(0, np.flatnonzero(text == 0x0A) + 1)
                held.append((plain[: 8 * size].view("<i8"), pa.Array.from_buffers(pa.large_string(), size, [None, pa.py_buffer(ends), pa.py_buffer(text)])))
            if not held:
                continue
            windows = pa.table({"n": pa.array(np.concatenate([n for n, _ in held])), "line": pa.chunked_array([x for _, x in held])})
            windows = windows.group_by("line").aggregate([("n", "sum")]).combine_chunks()
            lines, times = windows["line"].combine_chunks(), windows["n_sum"].to_numpy()
            rows = np.flatnonzero(pc.equal(own["lang"], lang).to_numpy())
            part = np.cumsum(pc.binary_length(own["pattern"]).to_numpy()[rows]) // BLOCK_PATTERN_BYTES
            for some in np.split(rows, np.flatnonzero(np.diff(part)) + 1):
                mine = own["pattern"].take(pa.array(some))
                machine = automata(uuid.uuid4().hex, {lang: (some, "\n".join(mine.to_pylist()))})[lang]
                f[some] = beginnings(machine, pc.utf8_length(mine).to_numpy().astype(np.int64), own["n_words"].to_numpy()[some] == 1, lines, times)
        automata("", {})
        counted = own.select(["lang", "pattern", "phrase", "n_words"]).append_column("f", pa.array(f))
        return counted.filter(pa.array(f > 0))

    windows = found.where("shard is not null").select("shard", "lang", "run").groupBy("shard")
    counts = windows.cogroup(listed.groupBy("shard")).applyInArrow(count, "lang string, pattern string, phrase string, n_words int, f long")
    return stage(spark, counts, "counted-patterns")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counted: DataFrame, min_count: int) -> DataFrame:
    """Candidates (lang, pattern, phrase, words) of ``min_count`` with a, l, r and score of the cut that scores least."""
    own = counted.where((F.col("n_words") >= 2) & (F.col("f") >= min_count)).withColumn("words", F.split("pattern", " "))
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.withColumns({"left": _part(F.col("words"), F.lit(1), F.col("k")), "right": _part(F.col("words"), F.col("k") + 1, F.col("n_words") - F.col("k"))})
    side = lambda part, name: counted.select("lang", F.col("pattern").alias(part), F.col("f").alias(name))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(f as decimal(20, 0)) div cast(l + r as decimal(20, 0))")
    least = both.withColumn("score", score).groupBy("lang", "pattern").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("phrase").alias("phrase"), F.first("words").alias("words"), F.first("f").alias("a"))
    return least.select("lang", "pattern", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def contained(own: DataFrame) -> DataFrame:
    """(lang, pattern, longest): the largest count of a longer candidate that a phrase lies in."""
    size = F.size("words")
    cut = own.where(size > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("length"))
    cut = cut.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    return cut.groupBy("lang", _part(F.col("words"), F.col("start"), F.col("length")).alias("pattern")).agg(F.max("a").alias("longest"))


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank: first of hashed parts of it, so no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))
    best = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("part")


def collocations(spark: SparkSession, docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    small_batches(spark)
    texts = _texts(docs, lang, text)
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits, n_shards = sketch_bits(n_bytes), max(1, -(-n_bytes // SHARD_TEXT_BYTES))
    runs = sketch_runs(spark, texts, bits)
    heavy = heavy_cells(spark, runs, min_count)
    found = found_in_heavy_cells(spark, texts, heavy, bits, n_shards)
    counted = pattern_counts(spark, found, patterns(candidates(spark, found, heavy), n_shards))
    own = stage(spark, scored(counted, min_count), "scored")
    within = (F.col("longest") * 100 >= F.col("a") * INSIDE_PERCENT)
    kept = own.join(contained(own), ["lang", "pattern"], "left").where(~F.coalesce(within, F.lit(False)))
    best = ranked(kept.select("lang", F.coalesce("phrase", "pattern").alias("phrase"), "a", "l", "r", "score"), top)
    sizes = runs.where("range is null").groupBy("lang").agg(F.sum("size").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
