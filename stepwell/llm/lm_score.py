"""Language-model scores from an Elias-Fano n-gram trie.

Tokens are words (runs of bytes other than white space, ASCII-lowered) and one
end per text.  The model interpolates three orders with absolute discounting:

    p1(w)     = (c(w) + 1) / (N + V + 1)                      every token
    p2(w|v)   = (c(vw) - D) / c(v)   + l(v)  p1(w)
    p3(w|u,v) = (c(uvw) - D) / c(uv) + l(uv) p2(w|v)

where an n-gram is stored if it was seen MIN_COUNT times or more, the first
term is 0 for one that is not, and l is what the stored ones leave of 1, so each
is a distribution.  The end of the previous text is the context of a first word.
Every token has a number, its place among the sorted hashes.  One seen less than
MIN_COUNT times can be in no n-gram that is stored, so it is passed over there.

A text's log10 probability is ``sum(log p1)`` and, per token, ``log(p2 / p1)``
and ``log(p3 / p2)``; these ratios and the logarithms of l are what the trie
holds, in 8 bits each, by a codebook of quantiles.

Layout.  The first level maps a 64-bit hash of a token to its count, an
Elias-Fano sequence of hashes per shard.  The second and third level are cut
into shards by the first word of the n-gram.  A level is an Elias-Fano sequence
of word numbers made monotone by adding the last value of the previous context;
a second one of pointers says where a context's range begins.  A query finds
``word + base`` by successor search inside the range of its context.  Shards are
files in the shared folder, built one per task and memory-mapped by the workers
that count n-grams and score; neither driver nor broadcast holds a token.

Defined cases: a null or empty text is its end alone; without training rows all
probabilities of a first token are 1 / (N + V + 1) with N = V = 0, so scores
are 0; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import EliasFano, dump, load, nested
from .staging import filesystem, new_dir, stage
from .text import LOWER, blocks, mix, release_memory, words_of

FOLDS, HELD_OUT = 7, 2
BITS = 31  # of a token's number
MIN_COUNT, DISCOUNT = 2, 0.75
SHARD_WORDS, SHARD_GRAMS, SHARD_PAIRS = 1 << 18, 1 << 19, 1 << 20
BLOCK_BYTES = 4_000_000
GATHER = 2_000_000  # counts or n-grams that a task holds before it sends them on
SEND_ROWS = 50_000  # rows that go to the JVM together
END = np.uint64(0x0E5D0F7E87)  # stands for the end among the hashes of words


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each text): the words of a text, then its end."""
    words = words_of(data, offsets)
    h = np.insert(words.hashes(LOWER[data]), words.first[1:], END)
    return h, words.first + np.arange(len(words.first))


def ordered(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers >= 0: one plain sort of their high bits with their places, which is much faster than an argsort."""
    bits = len(values).bit_length()
    values = values.view(np.uint64)
    drop = max(0, int(values.max()).bit_length() + bits - 64) if len(values) else 0
    packed = ((values >> np.uint64(drop)) << np.uint64(bits)) | np.arange(len(values), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << bits) - 1)).view(np.int64)
    if drop:  # numbers that differ in dropped bits alone may be out of order
        got = values[order]
        if (got[1:] < got[:-1]).any():
            return np.argsort(values, kind="stable")
    return order


def distinct_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers in order, which of them each number is)."""
    order = ordered(values)
    got = values[order]
    new = np.ones(len(got), bool)
    new[1:] = got[1:] != got[:-1]
    at = np.empty(len(got), np.int64)
    at[order] = np.cumsum(new) - 1
    return got[new], at


def _counted(docs: DataFrame, schema: str, keys_of) -> DataFrame:
    """Rows (key, n) of what ``keys_of`` finds in the texts of a block, added up within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0), BLOCK_BYTES):
                key, n = np.unique(keys_of(data, offsets), return_counts=True)
                held.append((key, n))
                size += len(key)
                if size > GATHER:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > GATHER // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["key", "n"])
                        held, size = [], 0
        if held:
            key, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The first level: a file per shard, and the number of the first token of each (one more at the end)."""

    files: list[str]
    starts: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, training count) of tokens by hash."""
        bits = len(self.files).bit_length() - 1
        number, count = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for k, at in _by_shard((hashes >> np.uint64(64 - bits)).astype(np.int64)):
            if self.files[k]:
                place, count[at] = _word_shard(self.files[k]).find(hashes[at] & np.uint64((1 << (64 - bits)) - 1))
                number[at] = np.where(place >= 0, place + self.starts[k], -1)
        return number, count

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        shard = np.searchsorted(self.starts, numbers, "right") - 1
        for k, at in _by_shard(shard):
            out[at] = _word_shard(self.files[k]).counts[numbers[at] - self.starts[k]]
        return out


def _distinct_grams(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, last, which of them each key is) of the distinct keys ``before * size + last``."""
    one, at = distinct_of(key)
    return one // size, one % size, at


def _pairs_of(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``u << BITS | v``, w) of every two tokens in a row and the one after them; w is -1 if that is rare or beyond the text."""
    h, first = token_hashes(data, offsets)
    distinct, back = distinct_of(h)
    number, count = words.find(distinct)
    token = np.where(count >= MIN_COUNT, number, -1)[back]
    before, _ = contexts(token, first, int(token[first[1] - 1]) if len(first) > 1 else -1)
    after = np.append(token[1:], -1)
    after[first[1:] - 1] = -1
    on = np.flatnonzero((before >= 0) & (token >= 0))
    return (before[on] << BITS) | token[on], after[on]


def _tally(pair: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (pair, w) in order, with the sum of their ``n`` (None: 1 each)."""
    if not len(pair):
        return pair, w, np.zeros(0, np.int64)
    second = pair & ((1 << BITS) - 1)
    order = ordered(((pair >> BITS) << int(second.max()).bit_length()) | second)
    pair = pair[order]
    new = np.diff(pair, prepend=-1) != 0
    width = int(w.max() + 1).bit_length()
    key = (np.cumsum(new) << width) | (w[order] + 1)  # place of the pair, then w
    if n is None:
        key.sort()
    else:
        again = ordered(key)
        key, n = key[again], n[order][again]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.diff(at, append=len(key)) if n is None else np.add.reduceat(n, at)
    return pair[at], (key[at] & ((1 << width) - 1)) - 1, total


def _packed(pair: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Counts in order of pair as four columns of 32 bits, byte by byte, compressed."""
    columns = np.stack([np.diff(pair >> BITS, prepend=0), pair & ((1 << BITS) - 1), w + 1, n]).astype("<u4")
    planes = np.ascontiguousarray(columns.view(np.uint8).reshape(4, -1, 4).transpose(0, 2, 1))
    return pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def _unpacked(content: bytes, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(content, 16 * rows, codec="zstd"), np.uint8).reshape(4, 4, rows)
    columns = np.empty((4, rows, 4), np.uint8)
    for k in range(4):  # a copy of whole planes is several times faster than one of the transposed array
        columns[:, :, k] = planes[:, k]
    u, v, w, n = columns.view("<u4")[:, :, 0].astype(np.int64)
    return (np.cumsum(u) << BITS) | v, w - 1, n


def _by_value(batches: Iterator[pa.RecordBatch], names: list[str], column: str = "shard") -> Iterator[tuple[int, list[dict[str, np.ndarray]]]]:
    """The rows of each value of a sorted column, as the pieces they came in."""
    now, parts = None, []
    for batch in batches:
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        value = columns[column]
        edges = np.flatnonzero(np.diff(value, prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:]):
            if now is not None and value[a] != now:
                yield now, parts
                parts = []
            now = int(value[a])
            parts.append({c: v[a:b] for c, v in columns.items()})
    if parts:
        yield now, parts


def _shares(words: Words, pair: np.ndarray, w: np.ndarray, n: np.ndarray, unit: float) -> pa.RecordBatch:
    """Stored n-grams of some pairs, whole: (u, v, w or -1, discounted share of the context, p1(v) if of two, what is left to (u, v))."""
    at = np.flatnonzero(np.diff(pair, prepend=-1))
    c2 = np.add.reduceat(n, at) if len(at) else n
    owner = np.repeat(np.arange(len(at)), np.diff(at, append=len(pair)))
    three = np.flatnonzero((w >= 0) & (n >= MIN_COUNT))
    share = (n[three] - DISCOUNT) / c2[owner[three]]
    rest = 1 - np.bincount(owner[three], share, len(at))
    two = np.flatnonzero(c2 >= MIN_COUNT)
    u, v = pair[at[two]] >> BITS, pair[at[two]] & ((1 << BITS) - 1)
    columns = {
        "u": np.concatenate([u, pair[three] >> BITS]),
        "v": np.concatenate([v, pair[three] & ((1 << BITS) - 1)]),
        "w": np.concatenate([np.full(len(two), -1), w[three]]),
        "share": np.concatenate([(c2[two] - DISCOUNT) / words.counts(u), share]),
        "unigram": np.concatenate([(words.counts(v) + 1) / unit, np.zeros(len(three))]),
        "rest": np.concatenate([rest[two], np.zeros(len(three))]),
    }
    return pa.RecordBatch.from_pydict(columns)


def _stored(texts: DataFrame, words, tokens: int, unit: float) -> DataFrame:
    """Rows of ``_shares`` of all texts.

    A task adds up what it finds and sends it on as compressed runs, one per
    shard; a shard is a hash of the pair, so no word is the key of a shuffle.
    The count of a pair is the sum over all that may follow it.
    """
    shards = _power(tokens, SHARD_PAIRS)
    shift = np.uint64(64 - (shards.bit_length() - 1))

    def runs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pair, w = (np.concatenate(x) for x in zip(*held))
        pair, w, n = _tally(pair, w)
        parts = list(_by_shard((mix(pair.view(np.uint64)) >> shift).astype(np.int64)))
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in parts], pa.int64()), pa.array([len(at) for _, at in parts], pa.int64()), pa.array([_packed(pair[at], w[at], n[at]) for _, at in parts], pa.binary())],
            names=["shard", "size", "run"],
        )

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0), BLOCK_BYTES):
                held.append(_pairs_of(words.value, data, offsets))
                size += len(held[-1][0])
                if size > GATHER:
                    yield runs(held)
                    held, size = [], 0
        if size:
            yield runs(held)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for _, parts in _by_value(batches, ["shard", "size", "run"]):
            unpacked = (_unpacked(r, int(k)) for p in parts for r, k in zip(p["run"], p["size"]))
            pair, w, n = _tally(*(np.concatenate(x) for x in zip(*unpacked)))
            rows = _shares(words.value, pair, w, n, unit)
            for i in range(0, len(rows), SEND_ROWS):
                yield rows.slice(i, SEND_ROWS)

    sent = texts.mapInArrow(found, "shard long, size long, run binary").repartition(shards, "shard").sortWithinPartitions("shard")
    return sent.mapInArrow(added, "u long, v long, w long, share double, unigram double, rest double")


def contexts(number: np.ndarray, first: np.ndarray, end_number: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the token before and of the one before that; -1 if rare or beyond the end before a text."""
    one, two = np.full(len(number), -1), np.full(len(number), -1)
    one[1:], two[2:] = number[:-1], number[:-2]
    begin = first[:-1]
    one[begin] = end_number
    two[begin] = -1
    second = begin + 1
    second = second[second < first[1:]]
    two[second] = end_number
    return one, two


@dataclass
class Model:
    """What queries need of the driver: totals and where the shards are."""

    tokens: int
    types: int
    words: Words
    gram_files: list[str]

    @property
    def log_unit(self) -> float:
        return float(np.log10(self.tokens + self.types + 1))


def _write(folder: str, name: str, content: bytes) -> str:
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    import uuid

    path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}.trie"
    with fs.open_output_stream(filesystem(path)[1], compression=None) as out:
        out.write(content)
    return path


def _built(rows: DataFrame, shards: int, order: list[str], folder: str, name: str, encode) -> list[str]:
    """Writes one file per value of ``shard`` and returns their paths by shard ('' for a shard without rows)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for k, parts in _by_value(batches, names):
            content = dump(encode({c: np.concatenate([p[c] for p in parts]) for c in names}))
            yield pa.RecordBatch.from_pydict({"shard": [k], "path": [_write(folder, f"{name}-{k:05d}", content)]})

    made = rows.repartition(shards, "shard").sortWithinPartitions("shard", *order).mapInArrow(run, "shard long, path string").collect()
    paths = {r["shard"]: r["path"] for r in made}
    return [paths.get(k, "") for k in range(shards)]


def _power(n: int, size: int, least: int = 8) -> int:
    return max(least, 1 << max(0, int(np.ceil(np.log2(max(1, n) / size)))))


def _encode_words(rows: dict[str, np.ndarray], shard_bits: int) -> dict[str, np.ndarray]:
    low = rows["key"].view(np.uint64) & np.uint64((1 << (64 - shard_bits)) - 1)
    return {**{f"keys.{k}": v for k, v in EliasFano.encode(low, 1 << (64 - shard_bits)).items()}, "counts": rows["n"].astype(np.uint64)}


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each value, codebook of at most 256 quantiles)."""
    book = np.unique(np.quantile(values, np.linspace(0, 1, 256), method="nearest")) if len(values) else np.zeros(1)
    middle = (book[1:] + book[:-1]) / 2
    return np.searchsorted(middle, values).astype(np.uint8), book.astype(np.float64)


def _level(context: np.ndarray, word: np.ndarray, n_contexts: int) -> dict[str, np.ndarray]:
    """Pointers and relative words of a level sorted by context and word."""
    starts = np.searchsorted(context, np.arange(n_contexts + 1))
    last = np.where(starts[1:] > starts[:-1], word[np.maximum(starts[1:], 1) - 1] + 1 if len(word) else 0, 0)
    base = np.concatenate([[0], np.cumsum(last)])  # a context's words lie above all before it
    value = base[context] + word
    out = {f"words.{k}": v for k, v in EliasFano.encode(value, int(base[-1]) + 1).items()}
    out |= {f"pointers.{k}": v for k, v in EliasFano.encode(starts, len(word) + 1).items()}
    return out


def _encode_grams(rows: dict[str, np.ndarray], shards: int, types: int) -> dict[str, np.ndarray]:
    """A shard: level 2 (contexts: u / shards) and level 3 (contexts: places in level 2)."""
    two = rows["w"] < 0
    u, v = rows["u"][two], rows["v"][two]
    per = -(-(types + 1) // shards)
    out = {f"two.{k}": x for k, x in _level(u // shards, v, per).items()}
    out["two_ratio"], out["two_book"] = _quantised(rows["ratio"][two])
    rest, out["one_rest_book"] = _quantised(rows["rest_one"][two])
    own = np.zeros(per, np.uint8)
    own[u // shards] = rest
    has = np.zeros(per, bool)
    has[u // shards] = True
    out["one_rest"], out["one_has"] = own, has.astype(np.uint8)
    three = ~two
    key = (u << BITS) | v
    parent = np.searchsorted(key, (rows["u"][three] << BITS) | rows["v"][three])
    out |= {f"three.{k}": x for k, x in _level(parent, rows["w"][three], len(u)).items()}
    ratio = np.log10(rows["ratio"][three] + 10 ** rows["rest_two"][two][parent]) if len(parent) else rows["ratio"][three]
    out["three_ratio"], out["three_book"] = _quantised(ratio)
    out["two_rest"], out["two_rest_book"] = _quantised(rows["rest_two"][two])
    return out


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """Counts the n-grams of ``docs`` and builds the trie in the shared folder."""
    folder = new_dir(spark, "trie")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    words = stage(spark, _counted(texts, "key long", lambda data, offsets: token_hashes(data, offsets)[0]), "words")
    total = words.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    shards = _power(total["types"], SHARD_WORDS)
    bits = shards.bit_length() - 1
    split = words.select(F.shiftrightunsigned("key", 64 - bits).alias("shard"), "key", "n")
    files = _built(split, shards, ["key"], folder, "words", lambda rows: _encode_words(rows, bits))

    if total["types"] >= 1 << BITS:
        raise ValueError(f"{total['types']} distinct tokens; a number has {BITS} bits")
    sizes = np.zeros(shards, np.int64)
    for row in split.groupBy("shard").count().collect():
        sizes[row["shard"]] = row["count"]
    shared = spark.sparkContext.broadcast(Words(files, np.concatenate([[0], np.cumsum(sizes)])))  # file names

    unit = float(total["tokens"] + total["types"] + 1)
    grams = stage(spark, _stored(texts, shared, total["tokens"], unit), "grams")
    two = grams.where(F.col("w") < 0)
    left = two.groupBy("u").agg((1 - F.sum("share")).alias("rest_one"))
    two = two.join(left, "u").withColumn("p2", F.col("share") + F.col("rest_one") * F.col("unigram"))
    two = stage(spark, two.select("u", "v", "p2", F.log10(F.col("p2") / F.col("unigram")).alias("ratio"), F.log10("rest_one").alias("rest_one"), "rest"), "two")
    gram_shards = _power(grams.count(), SHARD_GRAMS)
    # p3 / p2(w|v), where p2(w|v) and what is left to (u, v) are rows of ``two``
    lower = two.select(F.col("u").alias("v"), F.col("v").alias("w"), "p2")
    three = grams.where(F.col("w") >= 0).select("u", "v", "w", "share").join(lower, ["v", "w"])
    shard, none = (F.col("u") % gram_shards).alias("shard"), F.lit(0.0)
    rows = two.select(shard, "u", "v", F.lit(-1).cast("long").alias("w"), "ratio", "rest_one", F.log10("rest").alias("rest_two"))
    rows = rows.unionByName(three.select(shard, "u", "v", "w", (F.col("share") / F.col("p2")).alias("ratio"), none.alias("rest_one"), none.alias("rest_two")))
    gram_files = _built(rows, gram_shards, ["u", "v", "w"], folder, "grams", lambda r: _encode_grams(r, gram_shards, int(total["types"])))
    return Model(int(total["tokens"]), int(total["types"]), shared.value, gram_files)


def _mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a shard, memory-mapped where the shared folder is a mounted one."""
    from pyarrow import fs

    store, own = filesystem(path)
    if isinstance(store, fs.LocalFileSystem):
        return load(np.memmap(own, np.uint8, "r"))
    with store.open_input_file(own) as stream:
        return load(np.frombuffer(stream.read(), np.uint8))


class WordShard:
    def __init__(self, path: str):
        parts = _mapped(path)
        self.keys, self.counts = EliasFano(nested(parts, "keys")), parts["counts"]

    def find(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, count) of each hash."""
        zero = np.zeros(len(low), np.int64)
        at = self.keys.find(low, zero, zero + self.keys.n)
        return at, np.where(at >= 0, self.counts[at] if self.keys.n else 0, 0).astype(np.int64)


class GramShard:
    def __init__(self, path: str):
        self.parts = _mapped(path)
        self.levels = {k: (EliasFano(nested(self.parts, f"{k}.words")), EliasFano(nested(self.parts, f"{k}.pointers"))) for k in ("two", "three")}

    def child(self, level: str, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word below each context or -1, whether the context has any)."""
        words, pointers = self.levels[level]
        if not words.n:
            return np.full(len(context), -1), np.zeros(len(context), bool)
        new = np.diff(context, prepend=-1) != 0  # queries come by context, so one lookup serves many words
        which, context = np.cumsum(new) - 1, context[new]
        start, end = (x.astype(np.int64) for x in pointers.get_two(context))
        base = np.zeros(len(context), np.uint64)
        inner = np.flatnonzero(start > 0)
        base[inner] = words.get(start[inner] - 1) + np.uint64(1)
        start, end, base = start[which], end[which], base[which]
        return words.find(base + word.astype(np.uint64), start, end), end > start

    def gain_two(self, own: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 p2(v|u) / p1(v), place of u v or -1), where u is context ``own`` of this shard."""
        p = self.parts
        at, _ = self.child("two", own, v)
        missing = np.where(p["one_has"][own] > 0, p["one_rest_book"][p["one_rest"][own]], 0.0)
        return np.where(at >= 0, p["two_book"][p["two_ratio"][at]] if len(p["two_ratio"]) else 0.0, missing), at

    def gain_three(self, place: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 p3(w|u,v) / p2(w|v), where u v is at ``place``."""
        p = self.parts
        below, has = self.child("three", place, w)
        found = p["three_book"][p["three_ratio"][below]] if len(p["three_ratio"]) else 0.0
        return np.where(below >= 0, found, np.where(has, p["two_rest_book"][p["two_rest"][place]], 0.0))


@lru_cache(maxsize=4096)
def _word_shard(path: str) -> WordShard:
    return WordShard(path)


@lru_cache(maxsize=4096)
def _gram_shard(path: str) -> GramShard:
    return GramShard(path)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = ordered(shard)
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:]):
        yield int(shard[order[a]]), order[a:b]


def gains_two(model: Model, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 p2(v|u) / p1(v), place of u v in its shard or -1)."""
    shards = len(model.gram_files)
    out, place = np.zeros(len(u)), np.full(len(u), -1)
    for k, at in _by_shard(u % shards):
        if model.gram_files[k]:
            out[at], place[at] = _gram_shard(model.gram_files[k]).gain_two(u[at] // shards, v[at])
    return out, place


def gains_three(model: Model, u: np.ndarray, place: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log10 p3(w|u,v) / p2(w|v), where u v is at ``place`` of its shard."""
    out = np.zeros(len(u))
    on = np.flatnonzero(place >= 0)
    for k, at in _by_shard(u[on] % len(model.gram_files)):
        at = on[at]
        out[at] = _gram_shard(model.gram_files[k]).gain_three(place[at], w[at])
    return out


def score_block(model: Model, data: np.ndarray, offsets: np.ndarray):
    """(tokens, known tokens, base score, score) of each text."""
    n = len(offsets) - 1
    h, first = token_hashes(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(first))
    distinct, back = distinct_of(h)
    number, count = model.words.find(distinct)
    base = np.bincount(owner, (np.log10(count + 1.0) - model.log_unit)[back], n)
    known = np.bincount(owner, (count > 0)[back], n).astype(np.int64)
    w = np.where(count[back] >= MIN_COUNT, back, -1)
    end = int(w[first[1] - 1]) if n else -1
    v, u = contexts(w, first, end)
    score = base.copy()
    size = len(distinct) + 1
    number = np.append(number, model.types)  # of a token in no n-gram: never below any context
    on = np.flatnonzero(v >= 0)
    last = np.where(w[on] >= 0, w[on], size - 1)
    a, b, at = _distinct_grams(v[on] * size + last, size)
    gain, place = gains_two(model, number[a], number[b])
    score += np.bincount(owner[on], gain[at], n)
    pair = np.full(len(w), -1)
    pair[on] = at
    on = on[u[on] >= 0]
    last = np.where(w[on] >= 0, w[on], size - 1)
    of, c, at = _distinct_grams(pair[on - 1] * size + last, size)
    score += np.bincount(owner[on], gains_three(model, number[a[of]], place[of], number[c])[at], n)
    return np.diff(first), known, base, score


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""
    shared = spark.sparkContext.broadcast(model)  # file names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(0), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(1)[i:j], *map(pa.array, score_block(shared.value, data, offsets))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    picked = docs.select("text", "doc_id")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def score_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learns from all rows but the held-out fold, then scores all."""
    model = train(spark, docs.where(~held_out()))
    scored = score(spark, docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
