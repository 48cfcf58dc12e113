"""Near duplicates by BagMinHash over multisets of word shingles.

A document is the multiset of its SHINGLE-word windows (words: runs of bytes
other than white space; a shorter text is one shingle).  Two documents are
linked when their weighted Jaccard similarity, sum of minima over sum of
maxima, is THRESHOLD or more; groups are the connected components.

Signatures.  For every shingle a Poisson process lives on (weight, time).  The
weight axis is discretised into the units below the shingle's count and cut
dyadically ([0,1), [1,2), [2,4), ...); each interval has an own process, of a
rate equal to its width, from seeded hashes, and a point of an interval that
the count only partly covers is kept if its own weight lies below the count.
So a document has all points of its smaller copies, and the earliest point of a
register is shared with probability exactly the weighted Jaccard similarity.
Only points up to a time that fills all registers are made; the limit grows
for the few documents with an empty register.

Linking.
1. Documents with equal multisets form classes; the least node stands for each.
2. Bands of ROWS registers: two documents at the threshold share one of BANDS
   bands with probability 1 - 6e-6, two at half of it seldom.  Band rows are
   range-sorted, so a bucket of any size is spread over tasks; each row meets the
   first of its bucket in its task and the ends of tasks meet, so a bucket of k
   rows gives k edges, never all its pairs.
3. Each document is verified on the exact multisets against its least candidate;
   verified links make components.
4. All candidates make loose groups: two documents that share a band are in one.
   Where a loose group holds several components, all its pairs of different
   components are compared exactly, in pairs of blocks of about BLOCK documents
   and BLOCK_SHINGLES shingles: a large component has blocks of its own, small
   ones share blocks, and two blocks of one component never meet.  A pair of
   blocks is one matrix product over the shingles they share and gives at most one
   link per pair of components, so nothing of the size of all pairs is written.

Defined cases: documents without words (null or empty texts) are alone; equal
rows are one document; a row that repeats a doc_id with another text, or whose
doc_id is null, is a document of its own, whose node is a number from SURROGATE
up (a hash of id and text), so that groups are named by an id where one has it;
very long texts are one multiset each; an empty table has no row; other columns
are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .id_filter import IdFilter
from .staging import stage
from .text import blocks, mix, release_memory, seeded, shingles, words_of

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 6, 40
REGISTERS = ROWS * BANDS
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Least number that stands for a document that its doc_id does not tell apart.
SURROGATE = 1 << 62

_UNIT = 2.0**-53
_STRIDE = np.uint64(0x9E3779B97F4A7C15)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT


def multisets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of a block, sorted by text and shingle."""
    words = words_of(data, offsets)
    owner, h = shingles(words, words.hashes(), SHINGLE)
    if not len(h):
        return owner, h, np.zeros(0, np.int64)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def _arrivals(flat: np.ndarray, registers: int, text: np.ndarray, element: np.ndarray, top: np.ndarray, size: np.ndarray, low: int, width: int, many: int) -> None:
    """Enters the points up to time ``top`` of one interval's processes, ``many`` of each process at a time.

    Times are summed in order, so they are the same whatever ``many`` is.
    """
    time, step = np.zeros(len(text)), 0
    while len(text):
        h = mix(element[:, None] + _STRIDE * np.arange(step + 1, step + many + 1, dtype=np.uint64))
        wait = np.log(_uniform(h)) / -width
        wait[:, 0] += time
        times = np.cumsum(wait, axis=1) if many > 1 else wait
        row, column = np.nonzero(times <= top[:, None])
        second = mix(h[row, column])
        if width > 1:
            inside = low + width * _uniform(second) < size[row]
            row, column, second = row[inside], column[inside], second[inside]
        np.minimum.at(flat, text[row] * registers + (mix(second) % np.uint64(registers)).astype(np.int64), times[row, column])
        live = np.flatnonzero(times[:, -1] <= top)
        text, element, time, top, size = text[live], element[live], times[live, -1], top[live], size[live]
        step += many


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """First arrival time of each register (columns) of each text (rows); infinite for empty texts."""
    out = np.full((n, registers), np.inf)
    flat = out.reshape(-1)
    weight = np.bincount(owner, count, n)
    todo = np.flatnonzero(weight > 0)
    factor = np.log(registers) + 3.0
    with np.errstate(over="ignore"):
        while len(todo):
            limit = np.zeros(n)
            limit[todo] = registers / weight[todo] * factor
            on = np.flatnonzero(limit[owner] > 0)
            level, low, width = 0, 0, 1
            while len(on):
                expected = limit[owner[on]] * width
                for many, least, most in ((1, 0, 2), (8, 2, 16), (64, 16, np.inf)):
                    own = on[(expected >= least) & (expected < most)]
                    _arrivals(flat, registers, owner[own], seeded(shingle[own], level), limit[owner[own]], count[own], low, width, many)
                low, width = (1, 1) if level == 0 else (2 * low, 2 * width)
                level += 1
                on = on[count[on] > low]
            factor *= 2
            todo = todo[np.isinf(out[todo]).any(axis=1)]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signature), BANDS))
    for k in range(ROWS):
        h = seeded(h ^ bits[:, :, k], k)
    return h.view(np.int64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (shingles with repeats), k1 and k2 (hash of the multiset), bands (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(0)):
                n = j - i
                owner, shingle, count = multisets(data, offsets)
                size = np.bincount(owner, count, n).astype(np.int64)
                sums = []
                for seed in (101, 102):
                    total = np.zeros(n, np.uint64)
                    with np.errstate(over="ignore"):
                        np.add.at(total, owner, seeded(shingle, seed) * count.astype(np.uint64))
                    sums.append(mix(total).view(np.int64))
                keys = band_keys(signatures(owner, shingle, count, n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                lists = pc.if_else(pa.array(size > 0), lists, pa.scalar(None, lists.type))
                yield pa.RecordBatch.from_arrays([batch.column(1)[i:j], pa.array(size), *map(pa.array, sums), lists], names=["doc_id", "size", "k1", "k2", "bands"])

    picked = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, size long, k1 long, k2 long, bands array<bigint>")


def _stars(rows: DataFrame) -> DataFrame:
    """(u, v) of band rows (key, id) sorted by both: each row with the first of its bucket.

    The ends of a partition are reported as well (v null), since a bucket may go
    on in the next one; there are two of them per partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, first_id, last_id, edge = None, 0, 0, []
        for batch in batches:
            key, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            if not len(key):
                continue
            if not edge:
                edge.append((key[0], own[0]))
            begin = np.ones(len(key), bool)
            begin[1:] = key[1:] != key[:-1]
            head = own[np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))]
            if key[0] == last_key:
                head[key == last_key] = first_id
            both = np.unique(np.stack([np.maximum(own, head), np.minimum(own, head)], axis=1), axis=0)
            both = both[both[:, 0] != both[:, 1]]
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64())], names=["u", "v", "key"])
            last_key, first_id, last_id = key[-1], head[-1], own[-1]
        if edge:
            edge.append((last_key, last_id))
            yield pa.RecordBatch.from_arrays([pa.array([e[1] for e in edge]), pa.nulls(2, pa.int64()), pa.array([e[0] for e in edge])], names=["u", "v", "key"])

    return rows.mapInArrow(run, "u long, v long, key long")


def candidates(spark: SparkSession, reps: DataFrame) -> DataFrame:
    """Staged distinct (u, v), u > v, that connect representatives (id, bands) that meet in a band."""
    rows = reps.select(F.explode("bands").alias("key"), "id")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    met = stage(spark, _stars(ordered), "met")
    ends = Window.partitionBy("key").orderBy("u")
    over = met.where("v is null").select("u", F.lag("u").over(ends).alias("v")).where("u <> v")
    pairs = met.where("v is not null").select("u", "v").unionByName(over.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return stage(spark, pairs.distinct(), "pairs")


def _shingle_table(keyed: DataFrame) -> DataFrame:
    """node, and its multiset as bytes: sorted distinct shingles, then their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(0)):
                owner, shingle, count = multisets(data, offsets)
                edges = np.searchsorted(owner, np.arange(j - i + 1))
                rows = [shingle[a:b].tobytes() + count[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i:j], pa.array(rows, pa.binary())], names=["id", "bag"])

    return keyed.select("text", "id").mapInArrow(run, "id long, bag binary")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two multisets as ``_shingle_table`` writes them."""
    n, m = len(a) // 12, len(b) // 12
    x, y = np.frombuffer(a, "<u8", n), np.frombuffer(b, "<u8", m)
    p, q = np.frombuffer(a, "<u4", n, 8 * n), np.frombuffer(b, "<u4", m, 8 * m)
    k = np.searchsorted(y, x)
    k[k == m] = 0
    hit = np.flatnonzero(y[k] == x) if m else np.zeros(0, np.int64)
    shared = int(np.minimum(p[hit], q[k[hit]]).sum())
    return shared / max(1, int(p.sum()) + int(q.sum()) - shared)


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            ok = [i for i in range(batch.num_rows) if similarity(a[i].as_py(), b[i].as_py()) >= THRESHOLD]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(ok, pa.int64())) for c in (0, 1)], names=["u", "v"])

    x = bags.select(F.col("id").alias("u"), F.col("bag").alias("bag_u"))
    y = bags.select(F.col("id").alias("v"), F.col("bag").alias("bag_v"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "bag_u", "bag_v").mapInArrow(run, "u long, v long")


def _elements(bag: bytes) -> np.ndarray:
    """A multiset as a set: the hash of each shingle and the number of its occurrence."""
    n = len(bag) // 12
    shingle, count = np.frombuffer(bag, "<u8", n), np.frombuffer(bag, "<u4", n, 8 * n).astype(np.int64)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return mix(np.repeat(shingle, count) + _STRIDE * nth.astype(np.uint64))


def similarities(bags: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of a few hundred multisets."""
    sets = [_elements(b) for b in bags]
    size = np.array([len(x) for x in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    on = np.flatnonzero(often[code] > 1)  # what one of them has alone is no overlap
    column = np.cumsum(often > 1) - 1
    shared = np.zeros((len(sets), len(sets)))
    code, owner, step = column[code[on]], owner[on], 4096
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, [start, start + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[a:b], code[a:b] - start] = 1
        shared += part @ part.T
    return shared / np.maximum(size[:, None] + size[None, :] - shared, 1)


def _links_between(table: pa.Table) -> pa.Table:
    """Links between components of one pair of blocks, one per pair of components."""
    ids, label, side, bags = table["id"].to_numpy(), table["label"].to_numpy(), table["side"].to_numpy(), table["bag"].to_pylist()
    near = np.triu(similarities(bags) >= THRESHOLD, 1)
    i, j = np.nonzero(near & (label[:, None] != label[None, :]))
    both = side[i] != side[j] if (side != side[0]).any() else np.ones(len(i), bool)
    i, j = i[both], j[both]
    ends = np.sort(np.stack([label[i], label[j]], axis=1), axis=1)
    one = np.unique(ends, axis=0, return_index=True)[1] if len(i) else np.zeros(0, np.int64)
    return pa.table({"u": ids[i[one]], "v": ids[j[one]]})


def _block_links(spark: SparkSession, members: DataFrame, bags: DataFrame) -> DataFrame:
    """All links between components of the loose groups; members: id, loose, label, size."""
    blocks_of = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1))
    parts = members.groupBy("loose", "label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    large = (F.col("n") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES)
    small = lambda c: F.sum(F.when(large, 0).otherwise(F.col(c)))
    loose = parts.groupBy("loose").agg(F.count("*").alias("n_labels"), small("n").alias("n_small"), small("shingles").alias("small_shingles")).where("n_labels > 1")
    own = F.when(large, F.col("label"))
    cut = lambda what, n, size: F.pmod(F.xxhash64(what), blocks_of(F.col(n), F.col(size)))
    placed = members.join(parts, ["loose", "label"]).join(loose, "loose")
    placed = placed.select("id", "loose", "label", F.coalesce(own, F.lit(-1)).alias("pure"), own.isNotNull().alias("alone"), F.when(own.isNotNull(), cut("id", "n", "shingles")).otherwise(cut("label", "n_small", "small_shingles")).alias("part"))
    placed = stage(spark, placed, "blocks")
    blocks_ = placed.select("loose", F.struct("alone", "pure", "part").alias("b")).distinct()
    met = blocks_.withColumnRenamed("b", "a").join(blocks_, "loose").where((F.col("a") <= F.col("b")) & ~(F.col("a.alone") & F.col("b.alone") & (F.col("a.pure") == F.col("b.pure"))))
    sides = met.select("loose", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("own"))
    sides = sides.select("loose", "a", "b", "own.alone", "own.pure", "own.part", (F.col("own") == F.col("a")).cast("int").alias("side"))
    rows = sides.join(placed, ["loose", "alone", "pure", "part"]).join(bags, "id")
    return rows.select("loose", "a", "b", "id", "label", "side", "bag").groupBy("loose", "a", "b").applyInArrow(_links_between, "u long, v long")


def _surrogate(doc_id: Column, t: Column) -> Column:
    return F.lit(SURROGATE) + F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(0)), t), 2)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), F.coalesce(text, F.lit("")).alias("text"))


def _groups(spark: SparkSession, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, t (hash of the text), node, class_id and group_id of every different document."""
    keyed = _keyed(docs, doc_id, text)
    raw = stage(spark, fingerprints(keyed.select(F.struct("id", "t").alias("key"), "text"), "key", "text").select("doc_id.id", "doc_id.t", "size", "k1", "k2", "bands"), "prints")
    one = raw.groupBy("id", "t").agg(F.first("size").alias("size"), F.first("k1").alias("k1"), F.first("k2").alias("k2"))
    twice = one.where("id is not null").groupBy("id").agg(F.min("t").alias("t0"), F.count("*").alias("n")).where("n > 1").select("id", "t0")
    alone = F.col("id").isNull() | (F.col("t0").isNotNull() & (F.col("t") != F.col("t0")))
    node = F.when(alone, _surrogate(F.col("id"), F.col("t"))).otherwise(F.col("id"))
    prints = stage(spark, one.join(twice, "id", "left").select("id", "t", node.alias("node"), "size", "k1", "k2"), "documents")
    least = prints.where("size > 0").groupBy("k1", "k2").agg(F.min("node").alias("class_id"), F.max("size").alias("size"))
    bands = raw.where("size > 0").groupBy("k1", "k2").agg(F.first("bands").alias("bands"))
    reps = stage(spark, least.join(bands, ["k1", "k2"]), "classes")

    pairs = candidates(spark, reps.select(F.col("class_id").alias("id"), "bands"))
    needed = pairs.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    wanted = prints.join(needed, F.col("node") == F.col("n"), "left_semi").select("id", "t", "node")
    # a filter of fixed size keeps most texts out of the exact join, which has the same plan at every size
    seen = IdFilter(wanted.select((F.col("t")).alias("t")), "t")
    few = keyed.where(seen.maybe(F.col("t")))
    own = few.alias("f").join(wanted.alias("w").hint("merge"), F.col("f.id").eqNullSafe(F.col("w.id")) & (F.col("f.t") == F.col("w.t"))).select("f.text", F.col("w.node").alias("id"))
    bags = stage(spark, _shingle_table(own).groupBy("id").agg(F.first("bag").alias("bag")), "bags")
    seen.destroy()

    first = pairs.groupBy("u").agg(F.min("v").alias("v"))
    links = stage(spark, _verified(first, bags), "links")
    both = components(spark, links.select(F.lit(True).alias("linked"), "u", "v").unionByName(pairs.select(F.lit(False).alias("linked"), "u", "v")), "linked")
    labels, loose = both.where("linked"), both.where("not linked")
    members = loose.select(F.col("node").alias("id"), F.col("component").alias("loose")).join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
    members = members.join(reps.select(F.col("class_id").alias("id"), "size"), "id").select("id", "loose", F.coalesce("component", "id").alias("label"), "size")
    more = _block_links(spark, members, bags)
    groups = components(spark, links.unionByName(stage(spark, more, "more-links")))

    table = reps.select("k1", "k2", "class_id").join(groups.select(F.col("node").alias("class_id"), F.col("component").alias("group_id")), "class_id", "left")
    worded = lambda c: F.when(F.col("size") > 0, F.col(c)).alias(c)
    each = prints.select("id", "t", "node", worded("k1"), worded("k2"))
    return each.join(table, ["k1", "k2"], "left").select("id", "t", "node", F.coalesce("class_id", "node").alias("class_id"), F.coalesce("group_id", "class_id", "node").alias("group_id"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (least node of an equal multiset) and group_id (least node of the group).

    One row per different (doc_id, text); ids must be integers.
    """
    return _groups(spark, docs, doc_id, text).select(F.col("id").alias("doc_id"), "class_id", "group_id")


def filter_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each group, that of the least node, with its columns; of equal rows one stays."""
    groups = _groups(spark, docs, "doc_id", "text")
    row, table = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), docs.schema
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), row.alias("row"))
    repeated = whole.groupBy("id", "t").agg(F.count("*").alias("n")).where("n > 1")
    fate = groups.select("id", "t", (F.col("node") != F.col("group_id")).alias("goes")).join(repeated.select(F.col("id").alias("r_id"), F.col("t").alias("r_t"), "n"), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("t") == F.col("r_t")), "left")
    special = stage(spark, fate.where("goes or n is not null").select(F.col("id").alias("s_id"), F.col("t").alias("s_t"), "goes"), "fate")
    maybe = IdFilter(special, "s_t").maybe(F.col("t"))
    met = whole.where(maybe).join(special.hint("merge"), F.col("id").eqNullSafe(F.col("s_id")) & (F.col("t") == F.col("s_t")), "left").where(~F.coalesce("goes", F.lit(False)))
    once = met.where("goes is not null").groupBy("id", "t").agg(F.first("row").alias("row"))
    kept = whole.where(~maybe).select("row").unionByName(met.where("goes is null").select("row")).unionByName(once.select("row"))
    return kept.select(*(F.col("row").getField(f.name).alias(f.name) for f in table))
