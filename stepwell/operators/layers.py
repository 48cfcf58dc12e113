"""Similarity of layer representations: linear CKA and RSA distance.

Activations are rows (layer, stream, sample_id, vec).  The cells of Gram matrices
are in ``gram``, as tiles.  Here the metrics of whole layers come from sums of
products of dimensions, which form no pair of rows, and those of probe sets from
the same sums in one Arrow call per pair of aligned layers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gram import groups_of

EPSILON = 1e-8


def align_layers(spark: SparkSession, n_source: int, n_target: int) -> DataFrame:
    """(source_layer, target_layer): i maps to round(i * t / s), half to even, at most t - 1."""
    if n_source <= 0 or n_target <= 0:
        raise ValueError("layer counts must be positive")
    target = F.least(F.rint(F.col("id") * n_target / n_source), F.lit(n_target - 1))
    return spark.range(n_source).select(F.col("id").cast("int").alias("source_layer"), target.cast("int").alias("target_layer"))


def mean_pool(tokens: DataFrame, *keys: str) -> DataFrame:
    """Mean vector per group of token rows (vec)."""
    long = tokens.select(*keys, F.posexplode("vec").alias("i", "x"))
    means = long.groupBy(*keys, "i").agg(F.avg("x").alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec"))


def _sides(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, float]:
    if len(x) != len(y) or len(x) < least:
        raise ValueError(f"{least} or more samples, as many on both sides, are needed")
    return _of_moments(_moments(x, y), x.shape[1], y.shape[1])


def cka(x: np.ndarray, y: np.ndarray) -> float:
    """Linear CKA of two matrices with a row per sample, by sums of products of dimensions."""
    return _sides(x, y, 1)[0]


def rsa(x: np.ndarray, y: np.ndarray) -> float:
    """1 - cosine of the pairwise cosine similarities, by the same sums: linear in the samples."""
    return _sides(x, y, 2)[1]


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What cka and rsa need of the rows of both sides, as one vector that can be added up."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), EPSILON)
    u, v = unit(x), unit(y)
    a, b = (u * u).sum(1), (v * v).sum(1)  # the cells (i, i), which are no pairs
    parts = [[len(x)], x.sum(0), y.sum(0), x.T @ x, y.T @ y, x.T @ y, u.T @ u, v.T @ v, u.T @ v, [a @ a, b @ b, a @ b]]
    return np.concatenate([np.ravel(p).astype(np.float64) for p in parts])


def _of_moments(m: np.ndarray, p: int, q: int) -> tuple[float, float]:
    """(cka, RSA distance) from the moments of sides of p and q dimensions: no pair of rows is formed."""
    sizes = [1, p, q, p * p, q * q, p * q, p * p, q * q, p * q, 3]
    n, sx, sy, xx, yy, xy, uu, vv, uv, own = np.split(m, np.cumsum(sizes)[:-1])
    centred = lambda c, a, b: float(((c - np.outer(a, b).ravel() / n[0]) ** 2).sum())
    below = np.sqrt(centred(xx, sx, sx) * centred(yy, sy, sy))
    ss, tt, st = ((c @ c - d) / 2 for c, d in zip((uu, vv, uv), own))
    norm = np.sqrt(max(ss, 0.0)) * np.sqrt(max(tt, 0.0))
    return (0.0 if below < EPSILON else centred(xy, sx, sy) / below), (0.0 if norm < EPSILON else float(1 - st / norm))


def similarity_by(pairs: DataFrame, keys: list[str], p: int, q: int) -> DataFrame:
    """(keys, cka, cosine_distance) over all rows (keys, x, y) of a group, by sums of p x q cells.

    Tasks add up the cells of the groups that they hold; rows stay where they are.
    """
    size = 1 + p + q + 2 * (p * p + q * q + p * q) + 3
    m = len(keys)
    rows = pairs.where((F.size("x") == p) & (F.size("y") == q)).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), "x", "y")
    for i in range(m):
        rows = rows.where(F.col(f"k{i}").isNotNull())
    own = ", ".join(f"k{i} {rows.schema[i].dataType.simpleString()}" for i in range(m))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(i).type for i in range(m)]
            x, y = (np.array(batch.column(c).flatten(), np.float64).reshape(-1, w) for c, w in ((m, p), (m + 1, q)))
            for key, at in groups_of(batch, m):
                total[key] = total.get(key, 0.0) + _moments(x[at], y[at])
        for key, moments in total.items():
            columns = [pa.repeat(pa.scalar(v, t), size) for v, t in zip(key, types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(size)), pa.array(moments)], names=[*(f"k{i}" for i in range(m)), "cell", "m"])

    def finish(table: pa.Table) -> pa.Table:
        found = _of_moments(table.sort_by("cell")["m"].to_numpy(), p, q)
        return pa.table({**{f"k{i}": table[f"k{i}"][:1] for i in range(m)}, "cka": [found[0]], "cosine_distance": [found[1]]})

    by = [f"k{i}" for i in range(m)]
    summed = rows.mapInArrow(add, f"{own}, cell long, m double").groupBy(*by, "cell").agg(F.sum("m").alias("m"))
    return summed.groupBy(*by).applyInArrow(finish, f"{own}, cka double, cosine_distance double").withColumnsRenamed(dict(zip(by, keys)))


def similarity_of_all(pairs: DataFrame, p: int, q: int) -> DataFrame:
    """(layer, cka, cosine_distance) over all rows (layer, x, y) of a layer."""
    return similarity_by(pairs, ["layer"], p, q)


METRICS = {"cka": cka, "cosine_distance": rsa}


def compare_layers(source: DataFrame, target: DataFrame, alignment: DataFrame, metrics: tuple[str, ...] = ("cka", "cosine_distance"), *keys: str) -> DataFrame:
    """One row per aligned (source_layer, target_layer, stream) that both sides have.

    A group is the probe texts of one layer, stream and key (dozens of samples),
    compared in one Arrow call.
    """
    for m in metrics:
        if m not in METRICS:
            raise ValueError(f"unknown metric {m}")
    s = source.join(F.broadcast(alignment), source["layer"] == alignment["source_layer"]).select(*keys, "source_layer", "target_layer", "stream", "sample_id", F.col("vec").alias("x"))
    t = target.select(*keys, F.col("layer").alias("target_layer"), "stream", "sample_id", F.col("vec").alias("y"))
    group = [*keys, "source_layer", "target_layer", "stream"]
    joined = s.join(t, [*keys, "target_layer", "stream", "sample_id"]).select(*group, "sample_id", "x", "y")

    def compare(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("sample_id")
        x, y = (np.array(ordered[c].to_pylist(), dtype=np.float64) for c in ("x", "y"))
        out = {c: [ordered[c][0].as_py()] for c in group}
        return pa.table({**out, **{m: pa.array([METRICS[m](x, y)], pa.float64()) for m in metrics}}).cast(schema)

    types = {f.name: f.dataType.simpleString() for f in joined.schema}
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([*((c, arrow[types[c]]) for c in group), *((m, pa.float64()) for m in metrics)])
    return joined.groupBy(*group).applyInArrow(compare, ", ".join([*(f"{c} {types[c]}" for c in group), *(f"{m} double" for m in metrics)]))


def compare_conditions(students: DataFrame, teachers: DataFrame, alignment: DataFrame) -> DataFrame:
    """compare_layers for every condition and input set at once; sets that a side lacks are left out."""
    return compare_layers(students, teachers.join(students.select("condition", "input_set").distinct(), "input_set"), alignment, ("cka", "cosine_distance"), "condition", "input_set")


def layer_numbers(names: DataFrame, name: str = "name") -> DataFrame:
    """Names of decoder layers ('...layers.<n>') with their numbers, ordered."""
    n = F.regexp_extract(name, r"(?:^|\.)layers\.(\d+)$", 1)
    return names.where(n != "").select(name, n.cast("int").alias("layer")).orderBy("layer")
