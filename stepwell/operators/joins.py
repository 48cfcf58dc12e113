"""Join shapes of the evaluation code: positional, checked, interaction and coverage joins."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import global_place, sample_n, whole_row


def zip_strict(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of both sides by place in their order; sides of different length fail the query."""
    x = global_place(a, order_a).select("place", F.struct(*a.columns).alias("a"))
    y = global_place(b, order_b).select("place", F.struct(*b.columns).alias("b"))
    both = x.join(y, "place", "full")
    uneven = F.col("a").isNull() | F.col("b").isNull()
    return both.select(F.when(uneven, F.raise_error(F.lit("the sides differ in length")).cast("bigint")).otherwise(F.col("place")).alias("place"), "a", "b")


def require(df: DataFrame, dimension: DataFrame, key: str, what: str) -> DataFrame:
    """Rows with their dimension's columns; a key that the dimension lacks fails the query."""
    rows = df.select(F.col(key).alias("k"), whole_row(df).alias("row"))
    known = dimension.select(F.col(key).alias("k"), whole_row(dimension).alias("found"))
    checked = F.when(F.col("found").isNull(), F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.col("k").cast("string"))).cast(df.schema[key].dataType)).otherwise(F.col("k"))
    own = [checked.alias(key) if c == key else F.col("row").getField(c).alias(c) for c in df.columns]
    return rows.join(known, "k", "left").select(*own, *(F.col("found").getField(c).alias(c) for c in dimension.columns if c != key))


def layer_subset(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Vectors of the wanted layers; a wanted layer that is not there fails the query."""
    missing = wanted.select("layer").distinct().join(vectors.select("layer").distinct(), "layer", "left_anti").agg(F.collect_list("layer").alias("missing"))
    kept = vectors.join(wanted.select("layer").distinct(), "layer", "left_semi")
    checked = kept.join(F.broadcast(missing))  # one row
    return checked.withColumn("layer", F.when(F.size("missing") > 0, F.raise_error(F.concat(F.lit("unknown layers: "), F.to_json("missing"))).cast("int")).otherwise(F.col("layer"))).drop("missing")


def probe_texts(records: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded sample of user goals."""
    return sample_n(records, "task_id", n, seed).select("user_goal")


def interaction(cells: DataFrame, low: str, high: str) -> DataFrame:
    """Difference of two gains: (treated - control) at ``low`` minus the same at ``high``; cells: level, arm, rate."""
    at = lambda level, arm: F.max(F.when((F.col("level") == level) & (F.col("arm") == arm), F.col("rate")))
    gain = lambda level: at(level, "treated") - at(level, "control")
    return cells.agg(gain(low).alias("gain_low"), gain(high).alias("gain_high"), (gain(low) - gain(high)).alias("interaction"))


def tokenizers_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two tokenizers have equal fields and encodings; rows: field, value (JSON)."""
    both = a.select("field", F.col("value").alias("x")).join(b.select("field", F.col("value").alias("y")), "field", "full")
    return both.agg(F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("compatible"), F.array_sort(F.collect_list(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("field")))).alias("differing"))


def batch_stats(outputs: DataFrame) -> DataFrame:
    """Per generation batch: size, longest and total tokens, and how many outputs hit the budget."""
    return outputs.groupBy("batch").agg(F.count("*").alias("n"), F.max("n_tokens").alias("longest"), F.sum("n_tokens").alias("total"), F.sum((F.col("n_tokens") >= F.col("budget")).cast("long")).alias("hit_budget"))


def with_retries(save: Callable[[], None], attempts: int = 3, pause_s: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Tries a write a few times with growing pauses; False if it never worked, so the local copy stays."""
    for k in range(1, attempts + 1):
        try:
            save()
            return True
        except OSError:
            if k < attempts:
                sleep(pause_s * k)
    return False
