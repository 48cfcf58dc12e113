"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``, and any others that the
given table has, whatever their names.  An empty table passes through every stage
as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepwell.llm import decontaminate, near_dups, packing, quality_rules, toxicity
from stepwell.llm.queries import vocabulary
from stepwell.llm.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or over sentences is below toxicity.REJECT_FROM.

    Null and empty texts have no sentence and stay; very long texts are scored whole;
    repeated rows are decided alike; without labels nothing is toxic.
    """
    return toxicity.filter_documents(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source.

    Null and empty texts fail the base rules; a null language or source is a group of
    its own; very long texts are measured whole; repeated rows count and are decided
    alike; a value on a fence is kept.
    """
    return quality_rules.filter_documents(spark, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies.

    Exact copies and repeated rows are near copies; rows of one id with different
    texts are documents of their own; null and empty texts have no shingle and are no
    copies; very long texts are compared whole.
    """
    return near_dups.filter_documents(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a benchmark item.

    Null and empty texts and items match nothing; a score of exactly MIN_SCORE is a
    leak; very long texts are searched whole; repeated rows are decided alike; without
    items every document stays.
    """
    return decontaminate.filter_documents(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence.

    A null or empty text is its end token alone; a very long text is cut into as many
    pieces as it needs; repeated rows are packed each.
    """
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Trained scores, sketches, signatures and alignments have no SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(spark, step(spark, docs, sf_dir), name)
    return docs
