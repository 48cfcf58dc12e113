"""Tables of a report: pivots, reindexed means, paired differences, loss curves, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pivoted(rows: DataFrame, index: str, columns: str, values: list, value: str) -> DataFrame:
    """One row per ``index`` and one column per given value of ``columns``: the mean of ``value``, null over nothing."""
    return rows.groupBy(index).pivot(columns, values).agg(F.avg(value))


def reindexed_means(rows: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """Means per key in a given order; keys without rows stay, with nulls, and other keys go."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(order)), f"ord int, {key} string")
    means = rows.groupBy(key).agg(*(F.avg(v).alias(v) for v in values))
    return wanted.join(means, key, "left").select("ord", key, *values).orderBy("ord")


def closer(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """How often a exceeds b, and the mean and largest absolute difference."""
    gap = F.abs(F.col(a) - F.col(b))
    return pairs.groupBy(*keys).agg(F.count(gap).alias("n"), F.sum((F.col(a) > F.col(b)).cast("long")).alias("n_closer"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"))


def loss_curve(log: DataFrame, key: str, value: str, every: int = 1, order: str = "step") -> DataFrame:
    """Every ``every``-th step of a run's log with the change since the one before it."""
    kept = log.where(F.pmod(F.col(order), F.lit(every)) == 0)
    return kept.withColumn("change", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def first_rows(rows: DataFrame, order: str, n: int = 5) -> DataFrame:
    """A bounded sample for a log."""
    return rows.orderBy(order).limit(n)


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that should be unique and are not, with how often they occur."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
