"""A bounded sample of labelled texts that a classifier is fitted on.

Defined cases: null ids, labels and texts are left out, and so are texts of more
than MAX_TRAIN_BYTES; an id with several labels counts as the largest, one with
several texts as that of the least hash; empty texts are learned from; without
labels, or without texts, there are no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents whose crc32 of the id as text leaves this remainder by FOLDS are never learned from.
FOLDS, HELD_OUT = 4, 2
#: At most so many labelled documents, those with the smallest hash of their id, are learned from.
MAX_TRAIN_DOCS = 6000
#: Longer texts are not learned from; they are scored whole like all others.
MAX_TRAIN_BYTES = 100_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents outside the held-out fold.

    A document with several labels counts as the largest, one with several texts
    as that of the least hash; null ids, labels and texts are left out.  The
    chosen ids are bounded by ``limit``, so the join that fetches their texts
    broadcasts them and moves no other text.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    chosen = own.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= MAX_TRAIN_BYTES)).select("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
