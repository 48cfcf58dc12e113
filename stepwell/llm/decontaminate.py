"""Benchmark decontamination: the rarest n-grams that no alignment can lack, then local alignment.

The benchmark is a stated query set, taken in blocks of at most
BLOCK_BENCHMARK_BYTES, so what is sent to the executors has a fixed bound; more
items mean more blocks.  For each block:

1. One pass over the documents counts how often each word and each pair of words
   of the block occurs in the corpus.
2. An alignment of an item's n words with score MIN_SCORE * MATCH * n or more has at
   least MIN_SCORE n of them in common with the document, and at least
   (2 MIN_SCORE - 1) n - 1 pairs of neighbours; it spans at most (3 - 2 MIN_SCORE) n
   words there.  So of any (n - MIN_SCORE n) + h words of the item it holds h, and
   the same goes for pairs.  The seeds are the rarest of them in the corpus, words
   or pairs, with the h that makes the least work by these counts.
3. A second pass finds seeds, keeps the stretches that hold h of them within such a
   span, and of these the ones where as many words belong to the item at all as an
   alignment must have (a bitmap of the item's words, which never misses one).  The
   passage around is aligned with the item by Smith-Waterman over words, so
   inserted, dropped and replaced words cost little.  An item has leaked where the
   score is MIN_SCORE of a verbatim copy's or more; no alignment of that score is
   passed over, whatever the counts are.

No text is shuffled: documents meet the items where they are, so neither a
frequent passage nor a long document gathers in one task.

Words are runs of letters, digits and non-ASCII bytes, ASCII-lowered.

Defined cases: null and empty texts and items have no words and never match; an
item of fewer than MIN_ALIGNED words is found only word for word, as it says too
little to be told from others when edited; very long texts are searched whole;
equal items and repeated documents are reported each; an empty table of either
kind gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import stage
from .text import LOWER, Words, blocks, seeded, words_of

MIN_ALIGNED, MIN_PAIRED = 5, 6
#: What looking at a stretch costs, in seeds found.
STRETCH_COST = 30
#: Words of the passages that are aligned together.
TOGETHER = 200_000
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.6
BLOCK_BENCHMARK_BYTES = 4 << 20

_BYTES = np.arange(256)
_INSIDE = np.isin(_BYTES, [*range(48, 58), *range(65, 91), *range(97, 123)]) | (_BYTES >= 128)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    words = words_of(data, offsets, _INSIDE)
    return words, words.hashes(LOWER[data])


def grams(hashes: np.ndarray, owner: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of each window of ``size`` words inside a text."""
    at = np.flatnonzero(np.arange(len(hashes)) + size <= first[1:][owner]) if len(hashes) else np.zeros(0, np.int64)
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = seeded(h ^ hashes[at + k], k)
    return at, h


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best score, end in the passage) of a local alignment with linear gaps, a row of the item at a time."""
    best, end = 0, 0
    row = np.zeros(len(passage) + 1, np.int64)
    slope = -GAP * np.arange(len(passage) + 1)
    for word in item:
        now = np.maximum(row + GAP, 0)
        np.maximum(now[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH), out=now[1:])
        row = np.maximum.accumulate(now + slope) - slope
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def score_bounds(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """The best score of each item in its passage, for items of one length, all at once.

    Words are told apart by half of their hash, so a score may be too high, never too low.
    """
    width = max(map(len, passages))
    text = np.zeros((len(passages), width), np.uint32)
    for k, x in enumerate(passages):
        text[k, : len(x)] = x.astype(np.uint32) | np.uint32(1)  # 0 is no word
    own = np.stack(items).astype(np.uint32) | np.uint32(1)
    row = np.zeros((len(passages), width + 1), np.int32)
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    best = np.zeros(len(passages), np.int32)
    for k in range(own.shape[1]):
        now = np.maximum(row + np.int32(GAP), 0)
        np.maximum(now[:, 1:], row[:, :-1] + np.where(text == own[:, k : k + 1], np.int32(MATCH), np.int32(MISMATCH)), out=now[:, 1:])
        now += slope
        row = np.maximum.accumulate(now, axis=1) - slope
        np.maximum(best, row.max(axis=1), out=best)
    return best


def words_needed(n: int) -> int:
    """How many of an item's n words any alignment of MIN_SCORE matches."""
    return int(np.ceil(MIN_SCORE * n - 1e-9)) if n >= MIN_ALIGNED else n


def pairs_needed(n: int) -> int:
    return max(1, int(np.ceil((2 * MIN_SCORE - 1) * n - 1 - 1e-9)))


def span(n: int) -> int:
    """The most words of a document that such an alignment reaches over."""
    return int((3 - 2 * MIN_SCORE) * n + 1e-9)


def _work(rates: np.ndarray, need: int, reach: int) -> float:
    """Seeds found for each word of text, with STRETCH_COST for those near need - 1 others by chance."""
    rate = float(rates.sum())
    near, term = rate * reach, np.exp(-min(rate * reach, 700.0))
    below = 0.0
    for k in range(need - 1):
        below += term
        term *= near / (k + 1)
    return rate * (1 + STRETCH_COST * max(0.0, 1 - below))


def rare_seeds(words: np.ndarray, pairs: np.ndarray) -> tuple[int, np.ndarray, int]:
    """(words of a seed, places of the seeds, how many of them any alignment holds) of an item.

    words, pairs: how often its words and pairs occur for each word of the corpus.
    """
    n = len(words)
    best = (np.inf, 1, np.zeros(0, np.int64), 1)
    for size, rates, held, most in ((1, words, words_needed(n), n), (2, pairs, pairs_needed(n), n - 1)):
        if size == 2 and n < MIN_PAIRED:
            continue
        order = np.argsort(rates, kind="stable")
        for need in range(1, min(held, 12) + 1):
            own = order[: most - held + need]
            work = _work(rates[own], need, span(n))
            if work < best[0]:
                best = (work, size, own, need)
    return best[1:]


@dataclass
class Block:
    """Items of a block as word hashes, with the seeds (hash and item, sorted by hash), how many each needs, and bitmaps of their words."""

    ids: list
    items: list[np.ndarray]
    size: np.ndarray
    need: np.ndarray
    sizes: list[int]
    gram: np.ndarray
    item: np.ndarray
    bits: np.ndarray

    def find(self, hashes: np.ndarray, grams_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For hashes of windows: (which of them, first index) where they are among sorted ``grams_``."""
        k = np.searchsorted(grams_, hashes)
        k[k == len(grams_)] = 0
        hit = np.flatnonzero(grams_[k] == hashes) if len(grams_) else np.zeros(0, np.int64)
        return hit, k[hit]

    def may_hold(self, item: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether a word may be one of an item's; true for all that are."""
        out = np.ones(len(words), bool)
        for shift in (0, 9):
            bit = (words >> np.uint64(shift)) & np.uint64(511)
            out &= (self.bits[item * 8 + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


def items_of(texts: list[str]) -> list[np.ndarray]:
    """The word hashes of each item."""
    items: list[np.ndarray] = []
    for _, _, data, offsets in blocks(pa.array(texts, pa.large_string())):
        words, hashes = _words(data, offsets)
        items += [hashes[a:b] for a, b in zip(words.first, words.first[1:])]
    return items


def _windows(item: np.ndarray, size: int) -> np.ndarray:
    return grams(item, np.zeros(len(item), np.int64), np.array([0, len(item)]), size)[1]


def windows_of(items: list[np.ndarray]) -> np.ndarray:
    """The distinct words and pairs of items, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(_windows(x, size) for x in items for size in (1, 2) if len(x) >= size)]))


def benchmark_block(ids: list, texts: list[str], known: np.ndarray | None = None, counts: np.ndarray | None = None, total: int = 0) -> Block:
    """counts: of the windows ``known`` among ``total`` words of the corpus; without them, those of the block itself."""
    items = items_of(texts)
    if known is None:
        every = np.concatenate([np.zeros(0, np.uint64), *(_windows(x, size) for x in items for size in (1, 2) if len(x) >= size)])
        known, counts = np.unique(every, return_counts=True)
        total = max(1, sum(map(len, items)))
    rate = lambda h: (counts[np.searchsorted(known, h)] + 1) / (total + 1)
    need = np.ones(len(items), np.int64)
    gram, item, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], set()
    bits = np.zeros(8 * len(items), np.uint64)
    for i, h in enumerate(items):
        for shift in (0, 9):
            bit = (h >> np.uint64(shift)) & np.uint64(511)
            np.bitwise_or.at(bits, i * 8 + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        if len(h) >= MIN_ALIGNED:
            size, places, need[i] = rare_seeds(rate(_windows(h, 1)), rate(_windows(h, 2)))
            own = np.unique(_windows(h, size)[places])
        elif len(h):
            size, own = len(h), _windows(h, len(h))
        else:
            continue
        sizes.add(size)
        gram.append(own)
        item.append(np.full(len(own), i))
    gram, item = np.concatenate(gram), np.concatenate(item)
    order = np.lexsort((item, gram))
    return Block(ids, items, np.array([len(h) for h in items], np.int64), need, sorted(sizes), gram[order], item[order], bits)


def benchmark_texts(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of blocks of the query set; each holds at most BLOCK_BENCHMARK_BYTES, or one longer item."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).orderBy("i", "t")
    for row in rows.toLocalIterator():
        n = len(row["t"].encode())
        if ids and size + n > BLOCK_BENCHMARK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += n
    if ids:
        yield ids, texts


def corpus_counts(spark: SparkSession, docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """(how often each of the words and pairs ``known`` occurs, all words) in whole texts; a task sends one number for each it has seen."""
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n = np.zeros(len(own) + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                words, hashes = _words(data, offsets)
                n[-1] += len(hashes)
                owner = words.text_of_word()
                for size in (1, 2):
                    _, g = grams(hashes, owner, words.first, size)
                    k = np.searchsorted(own, g)
                    k[k == len(own)] = 0
                    if len(own):
                        n[:-1] += np.bincount(k[own[k] == g], minlength=len(own))
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(n[on])], names=["k", "n"])

    found = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each window of the block
    shared.destroy()
    counts = np.zeros(len(known) + 1, np.int64)
    counts[found["k"].to_numpy()] = found["n"].to_numpy()
    return counts[:-1], int(counts[-1])


def benchmark_blocks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, item_id: str, text: str) -> Iterator[Block]:
    """Blocks of the query set, with seeds that are rare in the texts of ``docs``."""
    for ids, texts in benchmark_texts(benchmark, item_id, text):
        known = windows_of(items_of(texts))
        yield benchmark_block(ids, texts, known, *corpus_counts(spark, docs, known))


def enough(block: Block, text: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each seed found (by item and place, distinct) is in a stretch that holds as many of its item's as an alignment must have."""
    first = np.arange(len(at))
    last = first + block.need[item] - 1
    inside = last < len(at)
    on, to = first[inside], last[inside]
    full = (text[on] == text[to]) & (item[on] == item[to]) & (at[to] - at[on] <= (3 - 2 * MIN_SCORE) * block.size[item[on]])
    n = len(at) + 1
    change = np.bincount(on[full], minlength=n) - np.bincount(to[full] + 1, minlength=n)
    return np.cumsum(change[:-1]) > 0


def stretches(block: Block, hashes: np.ndarray, owner: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, first word, end word) of the passages that may hold an alignment."""
    at, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in block.sizes:
        place, g = grams(hashes, owner, first, size)
        hit, k = block.find(g, block.gram)
        n = np.searchsorted(block.gram, g[hit], "right") - k
        which = np.repeat(np.arange(len(hit)), n)
        k = np.repeat(k, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at.append(place[hit[which]])
        item.append(block.item[k])
    room = max(1, len(hashes))
    key = np.concatenate(item) * room + np.concatenate(at)
    key.sort()
    key = key[np.diff(key, prepend=-1) != 0]
    item, at = key // room, key % room
    dense = enough(block, owner[at] if len(at) else at, item, at)
    item, at = item[dense], at[dense]
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    text, size = owner[at], block.size[item]
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(at) > 2 * size[1:])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(at)) - 1
    text, item, size = text[a], item[a], size[a]
    low, high = np.maximum(first[text], at[a] - 2 * size), np.minimum(first[text + 1], at[b] + 2 * size)
    # of these, where enough words are the item's at all
    length = high - low
    begin = np.cumsum(length) - length
    group = np.repeat(np.arange(len(length)), length)
    step = np.arange(int(length.sum()))
    own = np.concatenate([[0], np.cumsum(block.may_hold(item[group], hashes[low[group] + step - begin[group]]))])
    to = np.minimum(step + np.array([span(n) for n in range(int(size.max()) + 1)])[size][group], (begin + length)[group])
    most = int(size.max()) + 1
    full = np.maximum.reduceat(own[to] - own[step], begin) >= np.array([words_needed(n) for n in range(most)])[size]
    return text[full], item[full], low[full], high[full]


def scoring(block: Block, hashes: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which passages may score MIN_SCORE with their item: alignments of items of one length are scored together."""
    out = np.zeros(len(item), bool)
    size, length = block.size[item], high - low
    order = np.lexsort((length, size))
    a = 0
    while a < len(order):
        same = int(np.searchsorted(size[order], size[order[a]], "right"))
        b = a + 1
        while b < same and (b - a + 1) * length[order[b]] <= TOGETHER:
            b += 1
        own = order[a:b]
        out[own] = score_bounds([block.items[i] for i in item[own]], [hashes[x:y] for x, y in zip(low[own], high[own])]) >= MIN_SCORE * MATCH * size[own] - 1e-9
        a = b
    return out


def leaks_of_texts(block: Block, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first byte, end byte) of the best alignment of each item that leaked into a text."""
    words, hashes = _words(data, offsets)
    if not len(hashes) or not len(block.gram):
        return
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    found = stretches(block, hashes, words.text_of_word(), words.first)
    full = scoring(block, hashes, *found[1:])
    for t, i, low, high in zip(*(x[full].tolist() for x in found)):
        own, passage = block.items[i], hashes[low:high]
        score, end = smith_waterman(own, passage)
        share = score / (MATCH * len(own))
        if share >= (MIN_SCORE if len(own) >= MIN_ALIGNED else 1.0) and share > best.get((t, i), (0.0,))[0]:
            back = smith_waterman(own[::-1], passage[:end][::-1])[1]
            best[t, i] = (share, int(words.start[low + end - back] - offsets[t]), int(words.end[low + end - 1] - offsets[t]))
    for (t, i), at in best.items():
        yield (t, i, *at)


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, score, start_byte, end_byte) of every item found in a document."""
    picked = docs.select("text", F.col(doc_id).alias("doc_id"))
    kind = benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, item_id {kind}, score double, start_byte long, end_byte long"
    out = spark.createDataFrame([], schema)
    for block in benchmark_blocks(spark, docs, benchmark, item_id, "text"):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for i, j, data, offsets in blocks(batch.column(0)):
                    if found := list(leaks_of_texts(own, data, offsets)):
                        text, item, score, start, end = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(1)[i:j].take(pa.array(text)), pa.array([own.ids[k] for k in item]), pa.array(score), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                            names=["doc_id", "item_id", "score", "start_byte", "end_byte"],
                        )

        out = out.unionByName(stage(spark, picked.mapInArrow(run, schema), "leaks"))
        shared.destroy()
    return out


def has_leak(spark: SparkSession, block: Block, text: Column) -> Column:
    """Whether a text holds an item of the block, as a column: a filter that moves no row."""
    from pyspark.sql.functions import arrow_udf

    shared = spark.sparkContext.broadcast(block)

    @arrow_udf("boolean")
    def leaked(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for i, _, data, offsets in blocks(texts):
            for found in leaks_of_texts(shared.value, data, offsets):
                out[i + found[0]] = True
        return pa.array(out)

    return leaked(text)


def filter_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    out = docs
    for block in benchmark_blocks(spark, docs, benchmark, "item_id", "text"):
        out = out.where(~has_leak(spark, block, F.col("text")))
    return out
