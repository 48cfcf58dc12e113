"""Paired statistics as column arithmetic and joins."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbers import py_round

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """STRUCT<center, half> of the Wilson interval; null for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    grown = 1 + F.try_divide(F.lit(z * z), n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / grown
    return F.struct(((p + F.try_divide(F.lit(z * z), 2 * n)) / grown).alias("center"), half.alias("half"))


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p of the binomial(n, 1/2) test on discordant pairs; 1 without any.

    The tail is its largest term, whose logarithm is summed, times the sum of all
    terms in units of it, so no power of 1/2 underflows.
    """
    n, k = (only_a + only_b).cast("double"), F.least(only_a, only_b).cast("int")
    start = F.struct((n * F.lit(-math.log(2))).alias("log"), F.lit(1.0).alias("total"))
    step = lambda acc, i: F.struct((acc["log"] + F.ln((n - i + 1) / i)).alias("log"), (acc["total"] * (i / (n - i + 1)) + 1).alias("total"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: F.exp(acc["log"] + F.ln(acc["total"])))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail * 2))


def contrast(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """only_a, only_b, difference of means and exact p of paired 0/1 columns."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    counted = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when((x == 1) & (y == 0), 1)), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.when((x == 0) & (y == 1), 1)), F.lit(0)).alias("only_b"), (F.avg(x) - F.avg(y)).alias("difference")
    )
    return counted.withColumn("p", mcnemar(F.col("only_a"), F.col("only_b")))


def draw_index(seed: int, n: Column, *parts: Column) -> Column:
    """A reproducible index below n: 32 bits of the MD5 of seed and parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), n.cast("long"))


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """(i, key) of the distinct keys: templates or seeds, a few dozen."""
    keys = F.array_sort(F.collect_set(key))
    return df.agg(keys.alias("k")).select(F.posexplode("k").alias("i", key))


#: Up to so many cells the whole matrix is sent to the tasks; a larger one is joined.
MAX_CELLS = 1 << 20
#: Draws that are weighed together.
DRAWS_TOGETHER = 256


def draw_weights(seed: int, draws: np.ndarray, size: int, *tags: str) -> np.ndarray:
    """How often each of ``size`` keys is drawn in each draw: the counts of ``draw_index`` over as many slots as keys."""
    out = np.zeros((len(draws), size), np.int64)
    for row, draw in zip(out, draws.tolist()):
        head = "|".join([str(seed), *tags, str(draw), ""])
        for slot in range(size):
            row[int(hashlib.md5(f"{head}{slot}".encode()).hexdigest()[:8], 16) % size] += 1
    return out


def _order(keys) -> list:
    """Keys as Spark sorts them."""
    return sorted(set(keys), key=lambda k: (k is not None, k.encode() if isinstance(k, str) else k))


def _over_draws(spark: SparkSession, draws: int, of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(draw, difference) where ``of`` a block of draws gives a numerator and a denominator; draws over nothing are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for k in range(0, len(own), DRAWS_TOGETHER):
                block = own[k : k + DRAWS_TOGETHER]
                above, below = of(block)
                on = np.flatnonzero(below)
                yield pa.RecordBatch.from_arrays([pa.array(block[on]), pa.array(above[on] / below[on])], names=["draw", "difference"])

    return spark.range(draws).mapInArrow(run, "draw long, difference double")


def template_bootstrap(pairs: DataFrame, a: str, b: str, template: str, draws: int, seed: int) -> DataFrame:
    """(draw, difference): templates resampled with replacement, ratio of sums.

    Outcomes are added up per template first; a draw is a vector of weights, and all
    draws of a block are one product of it with the sums.  More than MAX_CELLS
    templates are joined with their slots instead.
    """
    cells = pairs.groupBy(template).agg(F.sum(F.col(a).cast("double")).alias("a"), F.sum(F.col(b).cast("double")).alias("b"), F.count("*").alias("n"))
    spark: SparkSession = pairs.sparkSession
    cells = cells.where(F.col(template).isNotNull())
    found = cells.limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        return _template_slots(spark, cells, template, draws, seed)
    at = {t: i for i, t in enumerate(_order(r[template] for r in found))}
    sums = np.zeros((len(at), 3))
    for r in found:
        sums[at[r[template]]] = r["a"] or 0, r["b"] or 0, r["n"]

    def of(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        drawn = draw_weights(seed, block, len(sums)) @ sums
        return drawn[:, 0] - drawn[:, 1], drawn[:, 2]

    return _over_draws(spark, draws, of)


def _template_slots(spark: SparkSession, cells: DataFrame, template: str, draws: int, seed: int) -> DataFrame:
    numbered = _numbered(cells, template).join(cells, template)
    size = cells.agg(F.count("*").alias("size"))
    slots = spark.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(size)).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    drawn = slots.withColumn("i", draw_index(seed, F.col("size"), F.col("draw"), F.col("slot")).cast("int"))
    return drawn.join(numbered, "i").groupBy("draw").agg((F.sum("a") / F.sum("n") - F.sum("b") / F.sum("n")).alias("difference"))


def crossed_bootstrap(rows: DataFrame, difference: str, seed_key: str, template: str, draws: int, seed: int) -> DataFrame:
    """(draw, difference): seeds and templates resampled independently, mean over the present cells.

    With the weights u of seeds and v of templates a draw is u D v / u P v, where D
    has the mean of each cell and P whether there is one: two products for a block of
    draws, however many slots were drawn.  A matrix of more than MAX_CELLS is joined
    with the drawn keys instead.
    """
    cells = rows.where(F.col(seed_key).isNotNull() & F.col(template).isNotNull()).groupBy(seed_key, template).agg(F.avg(F.col(difference).cast("double")).alias("d"))
    spark: SparkSession = rows.sparkSession
    size = cells.agg(F.count_distinct(seed_key).alias("s"), F.count_distinct(template).alias("t")).first()
    if size["s"] * size["t"] > MAX_CELLS:
        return _crossed_slots(spark, cells, seed_key, template, draws, seed)
    found = cells.collect()
    seeds, templates = ({k: i for i, k in enumerate(_order(r[c] for r in found))} for c in (seed_key, template))
    means, present = np.zeros((len(seeds), len(templates))), np.zeros((len(seeds), len(templates)))
    for r in found:
        at = seeds[r[seed_key]], templates[r[template]]
        if r["d"] is not None:
            means[at], present[at] = r["d"], 1

    def of(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = draw_weights(seed, block, len(seeds), "seed"), draw_weights(seed, block, len(templates), "template")
        return ((u @ means) * v).sum(1), ((u @ present) * v).sum(1)

    return _over_draws(spark, draws, of)


def _crossed_slots(spark: SparkSession, cells: DataFrame, seed_key: str, template: str, draws: int, seed: int) -> DataFrame:
    def slots(key: str, tag: str) -> DataFrame:
        numbered = _numbered(cells, key)
        size = numbered.agg(F.count("*").alias("size"))
        drawn = spark.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(size)).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
        drawn = drawn.withColumn("i", draw_index(seed, F.col("size"), F.lit(tag), F.col("draw"), F.col("slot")).cast("int"))
        return drawn.join(numbered, "i").groupBy("draw", key).agg(F.count("*").alias(f"n_{tag}"))

    met = slots(seed_key, "seed").join(cells.where("d is not null"), seed_key).join(slots(template, "template"), ["draw", template])
    weight = F.col("n_seed") * F.col("n_template")
    return met.groupBy("draw").agg((F.sum(F.col("d") * weight) / F.sum(weight)).alias("difference"))


def interval(draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval (linear interpolation), two-sided p (twice the smaller tail) and one-sided bound."""
    tail = F.least(F.avg((F.col("difference") <= 0).cast("double")), F.avg((F.col("difference") >= 0).cast("double")))
    return draws.agg(F.percentile("difference", low).alias("low"), F.percentile("difference", high).alias("high"), F.least(F.lit(1.0), tail * 2).alias("p"), F.percentile("difference", 0.95).alias("upper_bound"))


def equivalent(draws: DataFrame, margin: float) -> DataFrame:
    """Whether the 90 % interval lies inside +-margin (two one-sided tests at 5 %)."""
    return draws.agg(((F.percentile("difference", 0.05) > -margin) & (F.percentile("difference", 0.95) < margin)).alias("equivalent"))


def seed_sd(rows: DataFrame, value: str, seed_key: str, *keys: str) -> DataFrame:
    """Mean and sample SD over seeds of each seed's mean."""
    per_seed = rows.groupBy(*keys, seed_key).agg(F.avg(F.col(value).cast("double")).alias("m"))
    return per_seed.groupBy(*keys).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("*").alias("n_seeds"))


def cell(k: Column, n: Column) -> Column:
    """'%  (k/n)  [low-high]' of a rate, with ties of the exact value to even, as Python prints it."""
    w = wilson(k, n)
    tenth = lambda v: py_round(v * 100, 1)
    return F.format_string("%5.1f%%  (%d/%d)  [%.1f-%.1f]", tenth(F.try_divide(k, n).cast("double")), k, n, tenth(w["center"] - w["half"]), tenth(w["center"] + w["half"]))
