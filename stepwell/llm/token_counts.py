"""Token counts by a compiled finite-state transducer.

A byte-pair tokenizer of the sentencepiece kind is turned into a deterministic
transducer over characters.  After each character a state holds

* the last token of the tokenization of what was read so far, and
* for each earlier position from which the characters read so far are the
  beginning of some piece: that beginning, the last token before the position,
  and how many tokens fewer there were.

A piece that now ends at the read position is the new last token if it and the
token before it are a stable pair, that is, if the two texts joined tokenize
into exactly these two tokens; there is one such piece.  The transition is
annotated with the change of the token count, which may be negative where a
longer piece absorbs earlier tokens.  Pieces are short, so there are finitely
many states; they are compiled when first needed and kept in a hash table, which
starts over before a block when it has grown large.  So are the maps of whole
runs from the start state, told apart by two 64-bit hashes: the same word is
stepped through once per worker.

No piece continues over the edge from a non-space to a space mark, nor over a
character that the vocabulary lacks (it becomes one token per UTF-8 byte), so
a text falls into runs with a known start state.  Runs are cut into chunks and
all chunks of a block step through the transducer together, as array
operations.  A chunk's state map says, for an entry state, the exit state and the
count; its first entry state is what a warm-up over the characters before gives.
The maps are composed by a parallel prefix scan: in log steps every segment's map
is joined to that of the segment before it.  Where a map has no entry for the
state that the segment before leaves, the segment is entered from there until it
meets a state that it knows, so the result is exact whatever the warm-up gave.

Defined cases: null and empty texts have 0 tokens; a text of any length and of
any number of different words is counted whole, in slices of SLICE runs; repeated
rows are counted each; an empty table has no row; other columns are ignored,
whatever their names.  Special strings in a text are plain text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hash_table import Table
from .text import Words, blocks, told_apart

CHUNK, WARM_UP = 64, 48
#: What a worker remembers at most between blocks.
KNOWN_STEPS, KNOWN_RUNS = 600_000, 1_200_000
SLICE = 1 << 18
BLOCK_BYTES = 1_000_000
MARK = "▁"  # what the vocabulary has for a space
START = 0


class Transducer:
    """States and annotated transitions of one vocabulary, compiled on demand."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        library = self.library
        texts = {i: library.id_to_piece(i) for i in range(library.vocab_size()) if not (library.is_unknown(i) or library.is_control(i) or library.is_byte(i) or library.is_unused(i))}
        alphabet = sorted({c for t in texts.values() for c in t})
        if {c for c in alphabet} - set(texts.values()):
            raise ValueError("a character of the vocabulary is no piece of its own")
        if any(MARK in t.lstrip(MARK) for t in texts.values()):
            raise ValueError("a piece continues over the edge of a word")
        self.n_classes = len(alphabet) + 1
        self.class_of = np.zeros(0x110000, np.int32)
        for k, c in enumerate(alphabet):
            self.class_of[ord(c)] = k + 1
        self.mark = int(self.class_of[ord(MARK)])
        self.class_of[0x20] = self.mark
        self.child: list[dict[int, int]] = [{}]
        self.piece_at = [-1]
        self.text_of = {}
        for i, t in texts.items():
            if self._encode(t) != [i]:
                continue  # merges never make this piece
            self.text_of[i] = t
            node = 0
            for c in t:
                k = int(self.class_of[ord(c)])
                if k not in self.child[node]:
                    self.child[node][k] = len(self.child)
                    self.child.append({})
                    self.piece_at.append(-1)
                node = self.child[node][k]
            self.piece_at[node] = i
        self.forget_runs()
        self._forget_steps()

    def _encode(self, text: str) -> list[int]:
        """Tokens of a text without the leading space mark: after a line end nothing merges."""
        return self.library.encode("\n" + text)[2:]

    def forget_runs(self) -> None:
        self.runs = Table()
        self.check, self.of_run = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _forget_steps(self) -> None:
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: START}
        self.stable: dict[tuple[int, int], bool] = {}
        self.steps = Table()

    def _is_stable(self, a: int, b: int) -> bool:
        if (known := self.stable.get((a, b))) is None:
            known = self.stable[a, b] = self._encode(self.text_of[a] + self.text_of[b]) == [a, b]
        return known

    def _compile(self, key: int) -> tuple[int, int]:
        """(next state, change of the count) for state * n_classes + class."""
        state, c = self.states[key // self.n_classes], key % self.n_classes
        live, token, count = [], -1, 0
        for node, last, less in state:
            below = self.child[node].get(c)
            if below is None:
                continue
            piece = self.piece_at[below]
            if token < 0 and piece >= 0 and (last < 0 or self._is_stable(last, piece)):
                token, count = piece, less + 1
            if self.child[below]:
                live.append((below, last, less))
        if token < 0:
            raise ValueError("no stable piece ends here")
        found = tuple(sorted((node, last, less - count) for node, last, less in live)) + ((0, token, 0),)
        if (number := self.number.get(found)) is None:
            number = self.number[found] = len(self.states)
            self.states.append(found)
        return number, count

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, change of the count) of each."""
        keys = (state * self.n_classes + char).astype(np.uint64)
        value = self.steps.find(keys)
        missing = np.flatnonzero(value < 0)
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            found = np.array([self._compile(k) for k in new.tolist()], np.int64)
            found = found[:, 0] << 32 | (found[:, 1] + 1024)
            self.steps.put(new, found)
            value[missing] = found[back]
        return value >> 32, (value & 0xFFFFFFFF) - 1024

    def run(self, chars: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, count) of chunks ``chars[start : start + length]`` from their entry states."""
        order = np.argsort(-length, kind="stable")
        state, count, at = entry[order].astype(np.int64), np.zeros(len(order), np.int64), start[order]
        alive = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), "left")
        for k, n in enumerate(alive):  # those longer than k come first
            state[:n], adds = self.step(state[:n], chars[at[:n] + k])
            count[:n] += adds
        out_state, out_count = np.empty_like(state), np.empty_like(count)
        out_state[order], out_count[order] = state, count
        return out_state, out_count

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each text of a block."""
        if self.steps.n > KNOWN_STEPS:
            self._forget_steps()
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        edges = lead[offsets]
        full = np.flatnonzero(np.diff(edges))
        points = np.insert(points, edges[full], 0x20)  # the library begins a text with a space mark
        begins = edges[full] + np.arange(len(full))
        chars = self.class_of[points]
        known = chars > 0
        first = np.zeros(len(chars), bool)
        first[begins] = True
        first[1:] |= (chars[1:] == self.mark) & (chars[:-1] != self.mark) | ~known[:-1]
        run_start = np.flatnonzero(first & known)
        fresh = first | ~known
        run_end = np.append(np.flatnonzero(fresh), len(chars))
        run_end = run_end[np.searchsorted(run_end, run_start, "right")]

        owner = lambda at: full[np.searchsorted(begins, at, "right") - 1]
        total = np.zeros(n)
        for k in range(0, len(run_start), SLICE):
            some = slice(k, k + SLICE)
            total += np.bincount(owner(run_start[some]), self._known_counts(chars, run_start[some], run_end[some]), n)
        other = np.flatnonzero(~known)
        if len(other):
            p = points[other]
            size = 1 + (p >= 0x80).astype(np.int64) + (p >= 0x800) + (p >= 0x10000)
            total += np.bincount(owner(other), size, n)
        return np.rint(total).astype(np.int64)

    def _known_counts(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each run; different runs are stepped through once, remembered ones not at all."""
        wide = chars.astype("<u2" if self.n_classes < 1 << 16 else "<u4")
        size = wide.itemsize
        words = Words(wide.view(np.uint8), start, start * size, end * size, start)
        check = words.hashes(seed=1 << 40)
        key, first, back = told_apart(words.hashes(), check)
        if len(self.check) + len(key) > KNOWN_RUNS:
            self.forget_runs()
        at = self.runs.find(key)
        fresh = at < 0
        new = np.flatnonzero(fresh | (self.check[at] != check[first]) if len(self.check) else fresh)
        out = self.of_run[at] if len(self.check) else np.zeros(len(key), np.int64)
        if len(new):
            out[new] = self.run_counts(chars, start[first[new]], end[first[new]])
            if len(self.check) + len(new) <= KNOWN_RUNS:
                put = new[fresh[new]]
                self.runs.put(key[put], len(self.check) + np.arange(len(put)))
                self.check, self.of_run = np.concatenate([self.check, check[first[put]]]), np.concatenate([self.of_run, out[put]])
        return out[back]

    def run_counts(self, chars: np.ndarray, run_start: np.ndarray, run_end: np.ndarray) -> np.ndarray:
        """Tokens of runs that begin in the start state: maps of all chunks, composed by a prefix scan."""
        pieces = -(-(run_end - run_start) // CHUNK)
        head = np.cumsum(pieces) - pieces
        nth = np.arange(int(pieces.sum())) - np.repeat(head, pieces)
        start = np.repeat(run_start, pieces) + nth * CHUNK
        length = np.minimum(np.repeat(run_end, pieces) - start, CHUNK)
        entry = np.full(len(start), START, np.int64)
        inner = np.flatnonzero(nth)
        if len(inner):
            warm = np.minimum(WARM_UP, nth[inner] * CHUNK)
            entry[inner] = self.run(chars, start[inner] - warm, warm, entry[inner])[0]
        leave, count = self.run(chars, start, length, entry)
        # the map of a segment that begins at a chunk and ends before ``stop``: entry -> leave[stop - 1], sum of counts
        width = 1
        while width < int(pieces.max(initial=0)):
            later = np.flatnonzero((nth % (2 * width) == width))  # each joins the segment before it
            at, state = later, leave[later - 1]
            left = np.minimum(width, np.repeat(pieces, pieces)[later] - nth[later])
            while len(at):  # from the state that the segment before leaves, until a state that the map knows
                off = np.flatnonzero((state != entry[at]) & (left > 0))
                at, state, left = at[off], state[off], left[off]
                if len(at):
                    entry[at] = state
                    state, count[at] = self.run(chars, start[at], length[at], state)
                    leave[at] = state
                    at, left = at + 1, left - 1
                    inside = left > 0
                    at, state, left = at[inside], state[inside], left[inside]
            width *= 2
        return np.rint(np.bincount(np.repeat(np.arange(len(pieces)), pieces), count, len(pieces))).astype(np.int64)


@lru_cache(maxsize=2)
def transducer(model_file: str) -> Transducer:
    """One per Python worker: what is compiled serves all its tasks."""
    return Transducer(model_file)


def count_tokens(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, n_bytes and n_tokens of every row.  model_file: a path that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = transducer(model_file)
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(0), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k + 1)[i:j] for k in range(len(keep))), pa.array(np.diff(offsets)), pa.array(compiled.counts(data, offsets))],
                    names=[*(f"k{k}" for k in range(len(keep))), "n_bytes", "n_tokens"],
                )

    picked = docs.select(F.col(text).alias("text"), *(F.col(k).alias(f"k{n}") for n, k in enumerate(keep)))
    schema = ", ".join([*(f"k{n} {picked.schema[n + 1].dataType.simpleString()}" for n in range(len(keep))), "n_bytes long, n_tokens long"])
    return picked.mapInArrow(run, schema).withColumnsRenamed({f"k{n}": k for n, k in enumerate(keep)})
