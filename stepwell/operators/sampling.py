"""Seeded, reproducible selection: the order is the MD5 of a seed and a key, so it does not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_even, seeded_order
from ..sources.shared import cut


def ranked(df: DataFrame, seed: int, key: str, *strata: str) -> DataFrame:
    """Adds rn, the 1-based place of a row in its stratum's seeded order."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*strata).orderBy(seeded_order(seed, F.col(key)), key)))


def balance_and_split(df: DataFrame, stratum: str, key: str, cap: int, train_fraction: float, seed: int) -> DataFrame:
    """At most ``cap`` rows per stratum, the first half-to-even share of them 'train', the others 'test'."""
    capped = ranked(df, seed, key, stratum).where(F.col("rn") <= cap)
    counts = df.groupBy(stratum).agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    n_train = half_even(F.col("n") * train_fraction)
    return capped.join(F.broadcast(counts), stratum).withColumn("split", F.when(F.col("rn") <= n_train, "train").otherwise("test")).drop("n", "rn")


def subsample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int) -> DataFrame:
    """``per_stratum`` rows of each stratum; a smaller number gives a subset of a larger one."""
    return ranked(df, seed, key, stratum).where(F.col("rn") <= per_stratum).drop("rn")


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, all if there are fewer."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def evenly_spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """The rows at places floor(i * size / n) of an ordered table; all if n is its size or more.

    Places come from counts per range partition and not from one global window.
    """
    placed = global_place(df, order)
    size = df.count()
    if n >= size:
        return placed.drop("place")
    wanted = df.sparkSession.range(n).select(F.floor(F.col("id") * size / n).cast("long").alias("place"))
    return placed.join(F.broadcast(wanted), "place", "left_semi").drop("place")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs can clash with a helper's."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def columns_of(row: str, df: DataFrame) -> list[Column]:
    """The columns of ``df`` out of that struct."""
    return [F.col(row).getField(c).alias(c) for c in df.columns]


def global_place(df: DataFrame, order: str) -> DataFrame:
    """Adds place, the 0-based place in the order of ``order`` (unique), without a single-partition window.

    Ranges are drawn from a sample, and partitions may be joined: another run of the
    same plan can deal rows otherwise.  So each row is written with its partition and
    its place there, once, and both the sizes and the rows are read from that.
    """
    parted = df.select(whole_row(df).alias("row"), F.col(order).alias("by")).repartitionByRange("by").sortWithinPartitions("by").drop("by")
    numbered = cut(parted.select("row", F.monotonically_increasing_id().alias("at"))).select("row", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("own"))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))  # a row per partition
    placed = numbered.join(F.broadcast(starts), "part")
    return placed.select(*(c for c, name in zip(columns_of("row", df), df.columns) if name != "place"), (F.col("start") + F.col("own")).cast("long").alias("place"))


def striped(df: DataFrame, order: str, n: int, index: int) -> DataFrame:
    """Every n-th row from ``index``."""
    return global_place(df, order).where(F.pmod("place", F.lit(n)) == index).drop("place")


def _first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.select(whole_row(df).alias("row"), nth.alias("nth")).where("nth = 1").select(*columns_of("row", df))


def last_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return _first(df, key, [o.desc() for o in order])


def first_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return _first(df, key, list(order))


def top_n(counts: DataFrame, key: str, n: int, known: DataFrame, count: str = "n") -> DataFrame:
    """The n of the ``known`` keys with the largest counts (0 where there is none), ties by key; more than there are is an error."""
    every = known.select(key).distinct()
    if n > every.count():
        raise ValueError(f"{n} of fewer keys are wanted")
    zero = F.coalesce(count, F.lit(0)).alias(count)
    return every.join(counts.select(key, count), key, "left").select(key, zero).orderBy(F.desc(count), key).limit(n)


def most_common(df: DataFrame, key: str, first_seen: str, n: int = 40) -> DataFrame:
    """The n most frequent keys, ties in the order first seen."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"), F.min(first_seen).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(n)


def epoch_batches(df: DataFrame, key: str, seed: int, epoch: int, batch: int) -> DataFrame:
    """Rows of full batches only, in an order of the epoch's own."""
    order = seeded_order(seed, F.lit(epoch), F.col(key))
    size = df.count()
    placed = global_place(df.withColumn("_order", F.concat_ws("|", order, F.col(key).cast("string"))), "_order").drop("_order")
    return placed.withColumn("batch", F.floor(F.col("place") / batch).cast("long")).where(F.col("batch") < size // batch)


def inject_errors(tasks: DataFrame, order: str = "ord", every: int = 4) -> DataFrame:
    """Every fourth task of a chain length gets a failing step, which goes round the chain."""
    i = F.row_number().over(Window.partitionBy("chain_length").orderBy(order)) - 1
    return tasks.withColumn("_i", i).withColumn("injected_error_at_step", F.when(F.col("_i") % every == 0, F.floor(F.col("_i") / every) % F.col("chain_length")).cast("int")).drop("_i")
