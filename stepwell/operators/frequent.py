"""The most frequent keys: mergeable summaries find the candidates, which alone are counted.

A task keeps at most COUNTERS counters.  When there are twice as many, it takes the
count of the first that has to go from all of them, so a counter is too low by at
most what was taken in all; what is left of a task's counters, and what it took, is
its summary.  Summaries add up: a key's count lies between the sum of its counters
and that sum plus everything taken.  Keys that cannot be among the first n by these
bounds are dropped, and the rest, a number that does not grow with the table, are
counted in a second pass.  Where the bounds are too wide (a flat table of very many
keys), all keys are counted.

Defined cases: null keys are not counted; ties go to the key seen first, then to the
smaller one; fewer keys than n are all returned; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = 4096


def summaries(df: DataFrame, key: str) -> DataFrame:
    """(key, low) of each task's counters, and a row with a null key and what the task took from them."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        taken = 0
        kept = None
        for batch in batches:
            kept = batch.column(0).type
            counted = pc.value_counts(batch.column(0).drop_null())
            for k, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
                held[k] = held.get(k, 0) + n
            if len(held) > 2 * COUNTERS:
                n = np.fromiter(held.values(), np.int64, len(held))
                off = int(np.partition(n, len(n) - COUNTERS - 1)[len(n) - COUNTERS - 1])
                held = {k: v - off for k, v in held.items() if v > off}
                taken += off
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([*held, None], kept), pa.array([*held.values(), taken], pa.int64())], names=["key", "low"])

    return df.select(F.col(key).alias("key")).mapInArrow(run, f"key {kind}, low long")


def candidates(df: DataFrame, key: str, n: int) -> DataFrame | None:
    """The keys that may be among the n most frequent, or None where the summaries cannot tell."""
    merged = summaries(df, key).groupBy("key").agg(F.sum("low").alias("low"))
    first = merged.where("key is not null").orderBy(F.desc("low")).limit(n).collect()
    taken = merged.where("key is null").agg(F.coalesce(F.sum("low"), F.lit(0))).first()[0]
    least = first[-1]["low"] if len(first) == n else 0
    if taken and least <= taken:  # a key without any counter may be as frequent
        return None
    found = merged.where(F.col("key").isNotNull() & (F.col("low") + taken >= least))
    return found.select("key") if found.limit(2 * COUNTERS + 1).count() <= 2 * COUNTERS else None


def most_frequent(df: DataFrame, key: str, first_seen: str, n: int) -> DataFrame:
    """(key, n, first_seen) of the n most frequent keys, in order."""
    named = df.where(F.col(key).isNotNull())
    few = candidates(named, key, n)
    if few is not None:
        few = few.select(F.col("key").alias(key))
        named = named.select(key, first_seen).join(F.broadcast(few), key)  # at most 2 * COUNTERS rows
    counted = named.groupBy(key).agg(F.count("*").alias("n"), F.min(first_seen).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen", key).limit(n)
