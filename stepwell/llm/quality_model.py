"""Quality by a generalised additive model with pairwise interactions.

The score is the logistic of a sum of lookup tables, one per feature and one
per chosen pair of features.  Tables are learned by cyclic boosting: every
round visits each feature in turn and adds a shrunken tree of at most four
leaves, fitted to the current residuals over the feature's bins.  Pairs are
ranked by how much of the remaining residual a coarse two-way grid explains;
the best ones get tables by the same cycle with trees of one split per axis.
Scoring is a bin search and a table addition per feature, over whole batches.

Features are rates of ``doc_stats``; labels, lang, source and doc_id are never
inputs.  The fit runs on the driver over the counts (not the texts) of a
bounded sample (``labelled.training_rows``).

Defined cases: null and empty texts have all rates 0 and are scored like
others; very long texts are counted and scored whole; repeated rows score alike;
without labels every score is 0.5; an empty table has no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .doc_stats import COUNTS, doc_counts
from .labelled import held_out, training_rows
from .text import blocks

GOOD_FROM = 0.7
BINS, COARSE = 64, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 120, 40, 8, 0.15

#: Feature: (numerator, denominator); no denominator means the logarithm of the count.
FEATURES = {
    "words": ("n_words", None),
    "longest_word": ("longest_word", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "bangs": ("n_bangs", "n_words"),
    "digits": ("n_digits", "word_chars"),
    "capitals": ("n_capital_words", "n_words"),
    "ends": ("n_ends", "n_words"),
    "commas": ("n_commas", "n_words"),
    "short_words": ("n_short_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.log1p(counts[a]) if b is None else counts[a] / np.maximum(counts[b], 1) for a, b in FEATURES.values()], axis=1)


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, j], "right")]
        for (a, b), grid in zip(self.pairs, self.grids):
            z += grid[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.logit(x)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts halfway between neighbouring quantiles, so that a bin is never a single split value."""
    found = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1), method="nearest"))
    return (found[1:] + found[:-1]) / 2


def _leaves(grad: np.ndarray, hess: np.ndarray, depth: int = 2, ridge: float = 1.0) -> np.ndarray:
    """Leaf values over ordered bins of the tree of this depth that splits greedily."""
    if depth and len(grad) > 1:
        g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
        total_g, total_h = grad.sum(), hess.sum()
        gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > total_g**2 / (total_h + ridge) + 1e-9:
            return np.concatenate([_leaves(grad[:cut], hess[:cut], depth - 1, ridge), _leaves(grad[cut:], hess[cut:], depth - 1, ridge)])
    return np.full(len(grad), grad.sum() / (hess.sum() + ridge))


def _grid_leaves(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Leaf values of the best split of both axes into two, and its gain."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (grad, hess))
    best, cut = 0.0, (0, 0)
    n, m = grad.shape
    quarter = lambda x, i, j: (x[i, j], x[i, m] - x[i, j], x[n, j] - x[i, j], x[n, m] - x[i, m] - x[n, j] + x[i, j])
    for i in range(1, n):
        for j in range(1, m):
            gain = sum(a * a / (b + ridge) for a, b in zip(quarter(g, i, j), quarter(h, i, j)))
            if gain > best:
                best, cut = gain, (i, j)
    out = np.zeros_like(grad)
    if best:
        i, j = cut
        values = [a / (b + ridge) for a, b in zip(quarter(g, i, j), quarter(h, i, j))]
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = values
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    n_features = len(FEATURES)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Model(float(np.log(share / (1 - share))), [], [])
    if not len(y):
        empty = np.zeros(0)
        return Model(0.0, [empty] * n_features, [np.zeros(1)] * n_features, [empty] * n_features)
    model.edges = [_edges(x[:, j], BINS) for j in range(n_features)]
    model.coarse = [_edges(x[:, j], COARSE) for j in range(n_features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    z = np.full(len(y), model.bias)
    slope = lambda: (lambda p: (y - p, np.maximum(p * (1 - p), 1e-6)))(1.0 / (1.0 + np.exp(-z)))
    for _ in range(ROUNDS):
        for j, bins in enumerate(fine):
            g, h = slope()
            size = len(model.tables[j])
            step = RATE * _leaves(np.bincount(bins, g, size), np.bincount(bins, h, size))
            model.tables[j] += step
            z += step[bins]

    def cells(a: int, b: int):
        width = len(model.coarse[b]) + 1
        return rough[a] * width + rough[b], (len(model.coarse[a]) + 1, width)

    g, h = slope()
    ranked = []
    for a in range(n_features):
        for b in range(a + 1, n_features):
            at, shape = cells(a, b)
            ranked.append((_grid_leaves(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))[1], a, b))
    model.pairs = [(a, b) for gain, a, b in sorted(ranked, reverse=True)[:PAIRS] if gain > 0]
    model.grids = [np.zeros(cells(a, b)[1]) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            at, shape = cells(a, b)
            g, h = slope()
            step = RATE * _grid_leaves(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))[0]
            model.grids[k] += step
            z += step.ravel()[at]
    return model


def _counts_of(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(0)):
                c = doc_counts(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1)[i:j] for k in range(len(keep))), *(pa.array(c[n]) for n in COUNTS)], names=[*(f"k{k}" for k in range(len(keep))), *COUNTS])

    picked = docs.select(F.col(text).alias("text"), *(F.col(k).alias(f"k{n}") for n, k in enumerate(keep)))
    schema = ", ".join([*(f"k{n} {picked.schema[n + 1].dataType.simpleString()}" for n in range(len(keep))), *(f"{n} long" for n in COUNTS)])
    return picked.mapInArrow(run, schema).withColumnsRenamed({f"k{n}": k for n, k in enumerate(keep)})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    rows = training_rows(docs, labels, label).select("text", F.col("doc_id").cast("string").alias("doc_id"), F.col("label").cast("int").alias("label"))
    found = _counts_of(rows, ("doc_id", "label")).toArrow().sort_by("doc_id")
    return fit(features({n: found[n].to_numpy() for n in COUNTS}), found["label"].to_numpy().astype(np.float64))


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and the score of every row."""
    shared = spark.sparkContext.broadcast(model)  # tables of BINS values per feature, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(0)):
                s = shared.value.score(features(doc_counts(data, offsets)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1)[i:j] for k in range(len(keep))), pa.array(s)], names=[*(f"k{k}" for k in range(len(keep))), "score"])

    picked = docs.select(F.col(text).alias("text"), *(F.col(k).alias(f"k{n}") for n, k in enumerate(keep)))
    schema = ", ".join([*(f"k{n} {picked.schema[n + 1].dataType.simpleString()}" for n in range(len(keep))), "score double"])
    return picked.mapInArrow(run, schema).withColumnsRenamed({f"k{n}": k for n, k in enumerate(keep)})


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(spark, docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
