"""Exact duplicates: groups of one 128-bit content hash, told apart by their bytes.

Texts are equal when they are identical after the six ASCII white-space
characters are deleted.  Three steps, all of DataFrame functions:

1. One pass over the texts writes a narrow table: id, length and SHA-256 of the
   normalised text.  The first 128 bits of the digest are the content hash.
2. Rows are counted by content hash with a partial aggregation, so a text with
   many copies sends one row for each task.
3. Only texts of hashes that occur twice or more are read again: the least and
   the greatest normalised text of each are taken, again with a partial
   aggregation, so a task sends two texts of a group and not its copies.  Where
   the two are the same, all texts of the hash are.  Where they differ the hash
   has a collision, and its texts are told apart by their whole digests, whose
   bytes are compared in the same way (two texts of one SHA-256 are an error).

A fixed-size Bloom filter of the repeated hashes keeps other texts out of step
3; what it lets through by chance is a group of one text, which agrees with
itself.  Groups with at least one in HEAVY_SHARE of all rows are at most
HEAVY_SHARE in number and meet their rows by broadcast, so no task gathers the
copies of one text; all others meet by a shuffle.

Of equal texts the row with the most characters in its original text stays, then
the one of the smallest id, a null id last.

Defined cases: null texts count as empty and are equal to texts of white space
alone; rows that repeat an id are rows of their own, and of rows with the same
length and id one stays; very long texts are compared whole; an empty table gives
an empty one; other columns are ignored by ``duplicate_groups`` and kept by
``filter_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .id_filter import IdFilter
from .staging import stage

SPACE = " \t\n\x0b\f\r"
HASH_BYTES = 16
HEAVY_SHARE = 2048


def normalised(text: Column) -> Column:
    """A text without white space; a null is an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def content_hash(digest: Column) -> Column:
    """The content hash as a column: the first HASH_BYTES bytes of a SHA-256 in hex."""
    return F.unhex(F.substring(digest, 1, 2 * HASH_BYTES))


def _short(content: Column) -> Column:
    """64 bits of a content hash, for the filter."""
    return F.xxhash64(content)


def _narrow(spark: SparkSession, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    digest = F.sha2(normalised(F.col(text)), 256)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("size"), digest.alias("digest"))
    return stage(spark, rows, "content-hashes")


def _ends(hashed: DataFrame, *keys: str) -> DataFrame:
    """The keys whose texts are not all the same bytes: the least differs from the greatest."""
    return hashed.groupBy(*keys).agg(F.min("body").alias("least"), F.max("body").alias("most")).where("least <> most").select(*keys)


def collisions(spark: SparkSession, docs: DataFrame, counts: DataFrame, text: str) -> DataFrame:
    """The repeated content hashes whose texts are not all the same bytes."""
    repeated = counts.where("n > 1")
    maybe = IdFilter(repeated.select(_short(F.col("content")).alias("h")), "h")
    digest = F.sha2("body", 256)
    hashed = docs.select(normalised(F.col(text)).alias("body")).select("body", digest.alias("digest"), content_hash(digest).alias("content"))
    odd = stage(spark, _ends(hashed.where(maybe.maybe(_short(F.col("content")))), "content"), "collisions")
    maybe.destroy()
    if not odd.isEmpty() and not _ends(hashed.join(odd, "content", "left_semi"), "content", "digest").isEmpty():
        raise ValueError("different texts have one SHA-256")
    return odd


def group_keys(spark: SparkSession, docs: DataFrame, narrow: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``content`` and ``part``, groups with the row that stays): equal keys mean equal bytes.

    ``part`` tells the texts of a collision apart and is empty for all others.
    """
    keyed = narrow.withColumn("content", content_hash(F.col("digest")))
    counts = stage(spark, keyed.groupBy("content").agg(F.count("*").alias("n")), "content-counts")
    odd = collisions(spark, docs, counts, text)
    if odd.isEmpty():
        keyed = keyed.withColumn("part", F.lit(""))
    else:
        apart = keyed.join(odd, "content", "left_semi").withColumn("part", F.col("digest"))
        keyed = stage(spark, keyed.join(odd, "content", "left_anti").withColumn("part", F.lit("")).unionByName(apart), "keyed")
    first = F.struct(F.negative("size").alias("size"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    groups = keyed.groupBy("content", "part").agg(F.count("*").alias("group_size"), F.min_by(F.struct("doc_id", "row"), first).alias("stays"))
    return keyed, stage(spark, groups, "content-groups")


def duplicate_groups(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) of every row."""
    narrow = _narrow(spark, docs, doc_id, text)
    keyed, groups = group_keys(spark, docs, narrow, text)
    total = narrow.count()
    heavy = groups.where(F.col("group_size") * HEAVY_SHARE >= total)  # at most HEAVY_SHARE of them
    light = groups.where(F.col("group_size") * HEAVY_SHARE < total)
    key = ["content", "part"]
    known = keyed.join(F.broadcast(heavy), key).unionByName(keyed.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(light, key))
    return known.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), F.col("digest").alias("text_sha256"))


def filter_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``."""
    whole = stage(spark, docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")), "whole-rows")
    kept = stage(spark, duplicate_groups(spark, whole.select("id", F.col("whole.text").alias("text")), "id").where("kept").select(F.col("doc_id").alias("id")), "kept-rows")
    return whole.join(kept, "id", "left_semi").select(*(F.col("whole").getField(c).alias(c) for c in docs.columns))
