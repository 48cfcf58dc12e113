"""Gram matrices of many samples as tiles.

A matrix of all pairs of a layer's samples is never a join of rows.  Tasks pack the
rows they hold into blocks of at most TILE samples; a layer of B blocks has
B (B + 1) / 2 tiles, each a group of its own keyed by (layer, lower block, upper
block), and a tile is one matrix product.  No key has more than two rows.

The centred matrix needs no pass over the cells: its row means and its total follow
from the sum vector of each block, which are added up by layer, and subtracting the
mean vector from a block centres its rows and columns at once.

Vectors of one group have one length; a group of one sample has one cell, and no
pair; rows that repeat a sample are samples of their own; an empty table has no
cells.  Rows with a null key or vector are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

TILE = 1024
EPSILON = 1e-8


@dataclass
class Side:
    """The samples of a block: ids, and for each column its matrix and the layer's mean vector."""

    ids: np.ndarray
    matrix: dict[str, np.ndarray]
    mean: dict[str, np.ndarray]

    def centred(self, column: str) -> np.ndarray:
        return self.matrix[column] - self.mean[column]

    def unit(self, column: str) -> np.ndarray:
        x = self.matrix[column]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPSILON)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    n = len(column)
    width = {len(x) for x in (column[0], column[n - 1])} if n else {0}
    flat = np.asarray(column.flatten(), np.float64)
    if len(width) != 1 or len(flat) != n * next(iter(width)) or len(np.unique(np.diff(np.asarray(column.offsets)))) > 1:
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def groups_of(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key values, rows) of each group of a batch."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in range(n_keys):
        own = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        code = code * (int(own.max()) + 1) + own
    for c in np.unique(code):
        rows = np.flatnonzero(code == c)
        yield tuple(batch.column(k)[int(rows[0])].as_py() for k in range(n_keys)), rows


def blocks(vectors: DataFrame, keys: list[str], columns: list[str], sample: str) -> DataFrame:
    """(k0.., block, n, ids, and x<c> and s<c> for each column: rows of a block, and their sum), written once."""
    picked = vectors.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(sample).alias("id"), *(F.col(c).cast("array<double>").alias(f"x{i}") for i, c in enumerate(columns)))
    for c in picked.columns:
        picked = picked.where(F.col(c).isNotNull()) if c != "id" else picked
    m, kinds = len(keys), {f.name: f.dataType.simpleString() for f in picked.schema}
    schema = ", ".join([*(f"k{i} {kinds[f'k{i}']}" for i in range(m)), "block long, n int", f"ids array<{kinds['id']}>", *(f"x{i} array<double>, s{i} array<double>" for i in range(len(columns)))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        made = 0
        types: list[pa.DataType] = []

        def block(key: tuple, ids: pa.Array, parts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal made
            made += 1
            number = (TaskContext.get().partitionId() << 32) | made
            lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for x in parts for v in (x.ravel(), x.sum(0))]
            own = [*(pa.array([v], t) for v, t in zip(key, types)), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([ids.to_pylist()], pa.list_(types[m])), *lists]
            return pa.RecordBatch.from_arrays(own, names=[*(f"k{i}" for i in range(m)), "block", "n", "ids", *(f"{s}{i}" for i in range(len(columns)) for s in "xs")])

        for batch in batches:
            types = [batch.column(k).type for k in range(m + 1)]
            for key, rows in groups_of(batch, m):
                ids = batch.column(m).take(pa.array(rows))
                parts = [_matrix(batch.column(m + 1 + i).take(pa.array(rows))) for i in range(len(columns))]
                waiting = held.setdefault(key, [])
                waiting.append((ids, parts))
                if sum(len(i) for i, _ in waiting) >= TILE:
                    ids = pa.concat_arrays([i for i, _ in waiting])
                    parts = [np.concatenate([p[c] for _, p in waiting]) for c in range(len(columns))]
                    full = len(ids) // TILE * TILE
                    for a in range(0, full, TILE):
                        yield block(key, ids[a : a + TILE], [p[a : a + TILE] for p in parts])
                    held[key] = [(ids[full:], [p[full:] for p in parts])] if full < len(ids) else []
        for key, waiting in held.items():
            if waiting:
                yield block(key, pa.concat_arrays([i for i, _ in waiting]), [np.concatenate([p[c] for _, p in waiting]) for c in range(len(columns))])

    return cut(picked.mapInArrow(pack, schema))


def tiles(vectors: DataFrame, keys: list[str], columns: list[str], schema: str, of: Callable[[Side, Side, bool], dict], sample: str = "sample_id") -> DataFrame:
    """Rows (keys, ``schema``) of ``of(a, b, same)`` for every two blocks of a group; ``same`` is whether they are one."""
    packed = blocks(vectors, keys, columns, sample)
    own = [f"k{i}" for i in range(len(keys))]
    group = Window.partitionBy(*own)  # a row for each block
    place = packed.select(*own, "block", (F.row_number().over(group.orderBy("block")) - 1).alias("idx"), F.count("*").over(group).alias("size"), F.sum("n").over(group).alias("rows"))
    for i in range(len(columns)):
        sums = packed.select(*own, "block", F.posexplode(f"s{i}").alias("d", "s")).withColumn("t", F.sum("s").over(Window.partitionBy(*own, "d")))
        total = sums.groupBy(*own, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "t"))), lambda v: v["t"]).alias(f"t{i}"))
        place = place.join(total, [*own, "block"])
    sides = packed.drop(*(f"s{i}" for i in range(len(columns)))).join(place, [*own, "block"])
    sides = sides.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    sides = sides.withColumns({"lo": F.least("idx", "other"), "hi": F.greatest("idx", "other")}).drop("other", "block")
    out = ", ".join([*(f"k{i} {sides.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys))), schema])

    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        read = []
        for r in range(table.num_rows):
            n = table["n"][r].as_py()
            row = lambda c, r=r: np.asarray(table[c].combine_chunks()[r].values, np.float64)
            rows = table["rows"][r].as_py()
            read.append(Side(table["ids"].combine_chunks()[r].values.to_numpy(zero_copy_only=False), {c: row(f"x{i}").reshape(n, -1) for i, c in enumerate(columns)}, {c: row(f"t{i}") / rows for i, c in enumerate(columns)}))
        found = of(read[0], read[-1], len(read) == 1)
        n = len(next(iter(found.values())))
        return pa.table({**{k: pa.chunked_array([pa.repeat(table[k][0], n)]) for k in own}, **found})

    return sides.groupBy(*own, "lo", "hi").applyInArrow(product, out).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def centered_gram(vectors: DataFrame, *keys: str, vec: str = "vec", sample: str = "sample_id") -> DataFrame:
    """(keys, i, j, k): every cell of the doubly centred Gram matrix of each group."""
    kind = vectors.schema[sample].dataType.simpleString()

    def cells(a: Side, b: Side, same: bool) -> dict:
        k = a.centred(vec) @ b.centred(vec).T
        i, j, k = np.repeat(a.ids, len(b.ids)), np.tile(b.ids, len(a.ids)), k.ravel()
        return {"i": i, "j": j, "k": k} if same else {"i": np.concatenate([i, j]), "j": np.concatenate([j, i]), "k": np.concatenate([k, k])}

    return tiles(vectors, list(keys), [vec], f"i {kind}, j {kind}, k double", cells, sample)


def triangle(vectors: DataFrame, *keys: str, vec: str = "vec", sample: str = "sample_id") -> DataFrame:
    """(keys, i, j, s): the cosine similarity of every pair i < j of a group's samples."""
    kind = vectors.schema[sample].dataType.simpleString()

    def pairs(a: Side, b: Side, same: bool) -> dict:
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.ids)), np.arange(len(b.ids)), indexing="ij"))
        if same:
            i, j = i[i < j], j[i < j]
        s, p, q = (a.unit(vec) @ b.unit(vec).T)[i, j], a.ids[i], b.ids[j]
        return {"i": np.minimum(p, q), "j": np.maximum(p, q), "s": s}

    return tiles(vectors, list(keys), [vec], f"i {kind}, j {kind}, s double", pairs, sample)


def _least_that_rounds_to(value: float, digits: int) -> float:
    """The least number that is not below ``value``, rounded half away from zero, when it is rounded like it."""
    unit = Decimal(1).scaleb(-digits)
    rounds = lambda x: Decimal(repr(float(x))).quantize(unit, ROUND_HALF_UP)
    wanted = rounds(value)
    least = float(wanted - unit / 2)
    while rounds(least) < wanted:
        least = float(np.nextafter(least, np.inf))
    while rounds(below := float(np.nextafter(least, -np.inf))) >= wanted:
        least = below
    return least


def closest(vectors: DataFrame, *keys: str, vec: str = "vec", sample: str = "sample_id", digits: int = 6) -> DataFrame:
    """(keys, i, j, s): of the pairs of ``triangle`` the one with the largest rounded similarity, ties by i, then j.

    A tile gives its own best pair alone.
    """
    kind = vectors.schema[sample].dataType.simpleString()

    def best(a: Side, b: Side, same: bool) -> dict:
        s = a.unit(vec) @ b.unit(vec).T
        if same:
            s[np.tril_indices(len(a.ids))] = -np.inf
        if not s.size or s.max() == -np.inf:
            none = a.ids[:0]
            return {"i": none, "j": none, "s": np.zeros(0)}
        x, y = np.nonzero(s >= _least_that_rounds_to(float(s.max()), digits))
        i, j = np.minimum(a.ids[x], b.ids[y]), np.maximum(a.ids[x], b.ids[y])
        k = np.lexsort((j, i))[:1]
        return {"i": i[k], "j": j[k], "s": s[x, y][k]}

    found = tiles(vectors, list(keys), [vec], f"i {kind}, j {kind}, s double", best, sample).withColumn("s", F.round("s", digits))
    return found.groupBy(*keys).agg(F.min_by(F.struct("i", "j", "s"), F.struct(F.negative("s"), "i", "j")).alias("c")).select(*keys, "c.i", "c.j", "c.s")


def triangle_sums(vectors: DataFrame, *keys: str, vec: str = "vec", sample: str = "sample_id") -> DataFrame:
    """(keys, n_pairs, total, squares, least, most) of the pairs of ``triangle``, of which none leaves its tile."""

    def sums(a: Side, b: Side, same: bool) -> dict:
        s = a.unit(vec) @ b.unit(vec).T
        s = s[np.triu_indices(len(a.ids), 1)] if same else s.ravel()
        return {"n": [len(s)], "t": [s.sum()], "q": [(s * s).sum()], "least": [s.min()], "most": [s.max()]} if len(s) else {"n": [0], "t": [0.0], "q": [0.0], "least": pa.array([None], pa.float64()), "most": pa.array([None], pa.float64())}

    found = tiles(vectors, list(keys), [vec], "n long, t double, q double, least double, most double", sums, sample)
    return found.groupBy(*keys).agg(F.sum("n").alias("n_pairs"), F.sum("t").alias("total"), F.sum("q").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"))


def centered_norm(vectors: DataFrame, *keys: str, vec: str = "vec", sample: str = "sample_id") -> DataFrame:
    """(keys, norm): the sum of squares of the centred Gram matrix, added up inside the tiles."""

    def squares(a: Side, b: Side, same: bool) -> dict:
        k = a.centred(vec) @ b.centred(vec).T
        return {"norm": [float(np.vdot(k, k)) * (1 if same else 2)]}

    return tiles(vectors, list(keys), [vec], "norm double", squares, sample).groupBy(*keys).agg(F.sum("norm").alias("norm"))


def cka_by_tiles(pairs: DataFrame, *keys: str, x: str = "x", y: str = "y", sample: str = "sample_id") -> DataFrame:
    """CKA of the centred Gram matrices of two sides; 0 where the denominator vanishes."""

    def sums(a: Side, b: Side, same: bool) -> dict:
        p, q = (a.centred(c) @ b.centred(c).T for c in (x, y))
        w = 1 if same else 2
        return {"xy": [w * float(np.vdot(p, q))], "xx": [w * float(np.vdot(p, p))], "yy": [w * float(np.vdot(q, q))]}

    found = tiles(pairs, list(keys), [x, y], "xy double, xx double, yy double", sums, sample).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("xy", "xx", "yy")))
    below = F.sqrt(F.col("xx") * F.col("yy"))
    return found.select(*keys, F.when(below < EPSILON, 0.0).otherwise(F.try_divide("xy", below)).alias("cka"))


def rsa_by_tiles(pairs: DataFrame, *keys: str, x: str = "x", y: str = "y", sample: str = "sample_id") -> DataFrame:
    """1 - cosine of the upper triangles of both sides' cosine similarities; 0 where a norm vanishes."""

    def sums(a: Side, b: Side, same: bool) -> dict:
        s, t = (a.unit(c) @ b.unit(c).T for c in (x, y))
        if same:
            s, t = (m[np.triu_indices(len(a.ids), 1)] for m in (s, t))
        return {"st": [float(np.vdot(s, t))], "ss": [float(np.vdot(s, s))], "tt": [float(np.vdot(t, t))]}

    found = tiles(pairs, list(keys), [x, y], "st double, ss double, tt double", sums, sample).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("st", "ss", "tt")))
    below = F.sqrt("ss") * F.sqrt("tt")
    return found.select(*keys, F.when(below < EPSILON, 0.0).otherwise(1 - F.try_divide("st", below)).alias("cosine_distance"))
