"""Toxicity by multiple-instance learning over sentences.

A text is a bag of sentences (cut after ``.``, ``!``, ``?`` and line ends).  A
sentence's score is a logistic function of its words; the text is toxic if at
least one sentence is, so its score is the noisy-or of its sentences::

    P(text) = 1 - prod(1 - p(sentence))

Only texts carry labels.  The gradient of the text's likelihood flows through
the noisy-or to the sentences, so the fitted sentence scores also locate what
offends.  Words are runs of letters, digits and non-ASCII bytes, ASCII-lowered;
a word counts as itself and by its beginnings of PREFIXES bytes, which share
what is learned among inflected forms.  Only what is in MIN_TEXTS training texts
or more, and more often in positive ones than chance (MIN_Z standard errors),
has a weight.

The sample is bounded (``labelled.training_rows``).  Spark counts its hashed
words and keeps those that have a weight; only their places in the sentences
come to the driver, which fits a few thousand numbers.  The model is one table of
2**BITS weights.  Scoring is one Arrow pass without a shuffle.

Defined cases: null and empty texts have no sentence and score 0; texts of any
length are scored whole; repeated rows score alike; without any label, or
without any positive one, the score of every text is 0; an empty table has no
row; other columns, null or of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out, training_rows
from .staging import stage
from .text import LOWER, blocks, release_memory, seeded, words_of

BITS = 20
MIN_TEXTS, MIN_Z = 5, 5.0
PREFIXES = (4, 5, 6)
REJECT_FROM = 0.3
OFFENDS_FROM = 0.5
START_BIAS = -8.0  # log odds of a sentence that nothing is known of

_BYTES = np.arange(256)
_INSIDE = np.isin(_BYTES, [*range(48, 58), *range(65, 91), *range(97, 123)]) | (_BYTES >= 128)
_STOP = np.isin(_BYTES, np.frombuffer(b".!?\n", np.uint8))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of each word, sentence of each word, text of each sentence, first byte and end byte of each sentence).

    Features are an array of one column for the word and one per beginning;
    0 stands for none.  Sentences without a word are not listed.
    """
    words = words_of(data, offsets, _INSIDE)
    lowered = LOWER[data]
    whole = words.hashes(lowered)
    owner = words.text_of_word()
    if not len(owner):
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), none, none, none, none
    heads = words.heads(lowered)
    length = words.end - words.start
    hashed = [whole, *(np.where(length > k, seeded(heads & np.uint64((1 << 8 * k) - 1), k), 0) for k in PREFIXES)]
    feature = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in hashed], axis=1)
    stops = np.flatnonzero(_STOP[data])
    before = np.searchsorted(stops, words.start)
    new = np.ones(len(owner), bool)
    new[1:] = (before[1:] != before[:-1]) | (owner[1:] != owner[:-1])
    sentence = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(owner)) - 1
    return feature, sentence, owner[head], words.start[head], words.end[tail]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(at: np.ndarray, sentence: np.ndarray, owner: np.ndarray, labels: np.ndarray, size: int, rounds: int = 200, rate: float = 0.1, sparsity: float = 0.5) -> np.ndarray:
    """Weights of ``size`` features and the bias: Adam with an L1 penalty on the noisy-or likelihood.

    at and sentence: a feature and a sentence in which it stands; owner: the text of each sentence.
    """
    y, n = labels.astype(bool), len(owner)
    w = np.zeros(size + 1)  # the last is the bias
    w[-1] = START_BIAS
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        grad = gradient(w, at, sentence, owner, y)
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad**2 - square)
        pace = rate / (np.sqrt(square / (1 - 0.99**t)) + 1.0)
        w -= pace * mean / (1 - 0.9**t)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - sparsity * pace[:-1], 0.0)
    return w


def gradient(w: np.ndarray, at: np.ndarray, sentence: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the negative log likelihood of all texts: through the noisy-or to the sentences to the features."""
    z = np.clip(w[-1] + np.bincount(sentence, w[at], len(owner)), -60.0, 60.0)
    odds = np.bincount(owner, _softplus(z), len(y))
    pull = np.where(y, -1.0 / np.expm1(np.clip(odds, 1e-6, 50.0)), 1.0)
    slope = pull[owner] / (1.0 + np.exp(-z))
    return np.append(np.bincount(at, slope[sentence], len(w) - 1), slope.sum())


def score_block(model: Model, data: np.ndarray, offsets: np.ndarray):
    """(score of each text, text, score, first byte and end byte of each sentence)."""
    feature, sentence, owner, start, end = sentences(data, offsets)
    z = model.bias + np.bincount(sentence, model.weights[feature].sum(axis=1), len(owner))
    odds = _softplus(z)
    return -np.expm1(-np.bincount(owner, odds, len(offsets) - 1)), owner, np.exp(-_softplus(-z)), start, end


def _bags(rows: DataFrame) -> DataFrame:
    """(doc_id, label, feature, sentence): the words of each text, a row of features each, and their sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(0)):
                feature, sentence, owner, _, _ = sentences(data, offsets)
                first = np.searchsorted(owner[sentence], np.arange(j - i + 1)) if len(owner) else np.zeros(j - i + 1, np.int64)
                rows = [feature[a:b].ravel() for a, b in zip(first, first[1:])]
                numbers = [(sentence[a:b] - (sentence[a] if b > a else 0)).astype(np.int32) for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i:j], batch.column(2)[i:j], pa.array(rows, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.int32()))], names=["doc_id", "label", "feature", "sentence"])

    return rows.select("text", F.col("doc_id").cast("string").alias("doc_id"), F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id string, label int, feature array<int>, sentence array<int>")


def speaking_features(bags: DataFrame, n: int, positive: int) -> DataFrame:
    """(feature) in MIN_TEXTS texts or more and MIN_Z standard errors more often in positive ones."""
    each = bags.select("label", F.explode(F.array_distinct("feature")).alias("feature")).where("feature <> 0")
    counted = each.groupBy("feature").agg(F.count("*").alias("texts"), F.sum("label").alias("bad")).where(F.col("texts") >= MIN_TEXTS)
    share, negative = F.col("texts") / n, max(1, n - positive)
    error = F.sqrt(share * (1 - share) * (1 / positive + 1 / negative)) + 1e-9
    return counted.where((F.col("bad") / positive - (F.col("texts") - F.col("bad")) / negative) / error >= MIN_Z).select("feature")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    spark = docs.sparkSession
    bags = stage(spark, _bags(training_rows(docs, labels, label)), "bags")
    total = bags.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive")).first()
    weights = np.zeros(1 << BITS, np.float32)
    if not total["positive"]:
        return Model(weights, -np.inf)
    known = np.sort(speaking_features(bags, total["n"], total["positive"]).toArrow()["feature"].to_numpy())
    shared = spark.sparkContext.broadcast(known)  # less than 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            columns: list[list] = [[], [], []]
            for feature, own in zip(batch.column(2), batch.column(3)):
                feature, own = (x.values.to_numpy() for x in (feature, own))
                at = slot[feature.reshape(-1, 1 + len(PREFIXES))]
                row, column = np.nonzero(at >= 0)
                for held, value in zip(columns, (at[row, column], own[row], int(own[-1]) + 1 if len(own) else 0)):
                    held.append(value)
            arrays = [pa.array(columns[0], pa.list_(pa.int32())), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "label", "at", "sentence", "n"])

    found = bags.mapInArrow(run, "doc_id string, label int, at array<int>, sentence array<int>, n int").toArrow().sort_by("doc_id")
    shared.destroy()
    n = found["n"].to_numpy()
    at, sentence = (found[c].combine_chunks() for c in ("at", "sentence"))
    before = np.repeat(np.cumsum(n) - n, np.diff(at.offsets.to_numpy()))
    fitted = fit(at.flatten().to_numpy().astype(np.int64), sentence.flatten().to_numpy() + before, np.repeat(np.arange(len(n)), n), found["label"].to_numpy(), len(known))
    weights[known] = fitted[:-1]
    del found, at, sentence, before
    release_memory()
    return Model(weights, float(fitted[-1]))


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, score, n_sentences, n_offending, and the span (characters) and score of the worst sentence."""
    shared = spark.sparkContext.broadcast(model)  # 2**BITS floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(0)):
                n = j - i
                total, owner, p, start, end = score_block(own, data, offsets)
                worst, at = np.full(n, -1), np.zeros(n, np.float64)
                order = np.lexsort((-start, p, owner))
                worst[owner[order]] = order  # the last of each text: its highest, the first of equals
                has = worst >= 0
                at[has] = p[worst[has]]
                lead = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
                span = [np.where(has, lead[x[worst]] - lead[offsets[:-1]], -1) if len(x) else np.full(n, -1) for x in (start, end)]
                arrays = [pa.array(x) for x in (total, np.bincount(owner, minlength=n), np.bincount(owner[p >= OFFENDS_FROM], minlength=n), *span, at)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1)[i:j] for k in range(len(keep))), *arrays], names=[*(f"k{k}" for k in range(len(keep))), "score", "n_sentences", "n_offending", "worst_start", "worst_end", "worst_score"])

    picked = docs.select(F.col(text).alias("text"), *(F.col(k).alias(f"k{n}") for n, k in enumerate(keep)))
    schema = ", ".join([*(f"k{n} {picked.schema[n + 1].dataType.simpleString()}" for n in range(len(keep))), "score double, n_sentences long, n_offending long, worst_start long, worst_end long, worst_score double"])
    return picked.mapInArrow(run, schema).withColumnsRenamed({f"k{n}": k for n, k in enumerate(keep)})


def offending_sentences(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """One row per sentence that scores OFFENDS_FROM or more: doc_id, sentence (its text), score."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(0)):
                _, owner, p, start, end = score_block(shared.value, data, offsets)
                on = np.flatnonzero(p >= OFFENDS_FROM)
                texts = [data[start[k] : end[k]].tobytes().decode("utf-8", "replace") for k in on]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i:j].take(pa.array(owner[on])), pa.array(texts, pa.string()), pa.array(p[on])], names=["doc_id", "sentence", "score"])

    picked = docs.select("text", "doc_id")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, sentence string, score double")


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and what ``score`` adds, for every row."""
    scored = score(spark, docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT_FROM).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_start", "worst_end", "worst_score")


def is_toxic(spark: SparkSession, model: Model, text: Column) -> Column:
    """Whether a text scores REJECT_FROM or more, as a column: a filter that moves no row."""
    from pyspark.sql.functions import arrow_udf

    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("boolean")
    def toxic(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.bool_())
        return pa.array(np.concatenate([score_block(shared.value, data, offsets)[0] >= REJECT_FROM for _, _, data, offsets in blocks(texts)]))

    return toxic(text)


def filter_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns."""
    return docs.where(~is_toxic(spark, train(docs, labels), F.col("text")))
