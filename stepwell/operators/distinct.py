"""Distinct counts and overlaps by theta sketches, exact where a sketch cannot decide.

A theta sketch of at most NOMINAL distinct keys holds all of them: its estimate is the
count, and set operations on it are exact.  A larger one is a uniform sample of
hashes; then a key found in two sets proves that they overlap, but finding none
proves nothing.  So one pass makes the sketches, sets of any size are compared by
them, and only the groups or pairs that stay open are read once more.

Defined cases: null keys are no keys; a set without keys has none in common with
any; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_NOMINAL = 12
NOMINAL = 1 << LG_NOMINAL
#: Bounds are so many standard errors from an estimate, each 1 / sqrt(NOMINAL) of it.
ERRORS = 3


def sketch(key: Column) -> Column:
    """Aggregate: the theta sketch of the keys that are not null."""
    return F.theta_sketch_agg(key, LG_NOMINAL)


def sketches(df: DataFrame, key: str, *groups: str) -> DataFrame:
    """(groups, rows, sketch, estimate): one pass, and a sketch of bounded size from each task."""
    made = df.groupBy(*groups).agg(F.count(key).alias("rows"), sketch(F.col(key)).alias("sketch"))
    return made.withColumn("estimate", F.theta_sketch_estimate("sketch"))


def distinct_bounds(df: DataFrame, key: str, *groups: str) -> DataFrame:
    """(groups, rows, estimate, low, high, exact): the bounds are the count itself where ``exact``."""
    off = F.when(F.col("estimate") <= NOMINAL, 0.0).otherwise(ERRORS / NOMINAL**0.5)
    bounds = sketches(df, key, *groups).select(*groups, "rows", "estimate", (off == 0).alias("exact"), off.alias("off"))
    return bounds.select(*groups, "rows", "estimate", F.floor(F.col("estimate") * (1 - F.col("off"))).alias("low"), F.ceil(F.col("estimate") * (1 + F.col("off"))).alias("high"), "exact")


def distinct_counts(df: DataFrame, key: str, *groups: str) -> DataFrame:
    """(groups, rows, n): exact numbers of distinct keys; groups that a sketch holds whole are not read again."""
    made = distinct_bounds(df, key, *groups)
    known = made.where("exact").select(*groups, "rows", F.col("estimate").cast("long").alias("n"))
    own = made.where("not exact").select(*(F.col(g).alias(f"open_{g}") for g in groups), "rows")
    same = F.lit(True)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"open_{g}"))
    again = df.select(*groups, key).join(own, same).groupBy(*groups, "rows").agg(F.count_distinct(key).alias("n"))
    return known.unionByName(again.select(*groups, "rows", "n"))


def unique_keys(df: DataFrame, key: str, *groups: str) -> DataFrame:
    """(groups, unique): whether no key of a group occurs twice."""
    return distinct_counts(df, key, *groups).select(*groups, (F.col("n") == F.col("rows")).alias("unique"))


def overlaps(df: DataFrame, key: str, name: str) -> DataFrame:
    """(a, b, overlap, by): for every two sets of a table (set ``name``, ``key``), whether they share a key.

    by: ``sketch`` or ``keys``, what decided.
    """
    made = sketches(df.where(F.col(name).isNotNull()), key, name).select(F.col(name).alias("set"), "sketch", "estimate")
    a, b = made.alias("a"), made.alias("b")  # a row for each set
    both = F.theta_sketch_estimate(F.theta_intersection(F.col("a.sketch"), F.col("b.sketch")))
    whole = (F.col("a.estimate") <= NOMINAL) & (F.col("b.estimate") <= NOMINAL)
    pairs = a.join(b, F.col("a.set") < F.col("b.set")).select(F.col("a.set").alias("a"), F.col("b.set").alias("b"), (both > 0).alias("overlap"), ((both > 0) | whole).alias("decided"))
    left = pairs.where("not decided")
    open_sets = left.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    keys = df.select(F.col(name).alias("set"), F.col(key).alias("key")).where("key is not null").join(open_sets, "set", "left_semi").distinct()
    met = keys.groupBy("key").agg(F.array_sort(F.collect_set("set")).alias("sets")).where(F.size("sets") > 1)  # the sets of one key, of which there are few
    met = met.select(F.explode(F.transform("sets", lambda s: s)).alias("a"), "sets").select("a", F.explode("sets").alias("b")).where("a < b").distinct().withColumn("met", F.lit(True))
    found = left.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("met", F.lit(False)).alias("overlap"), F.lit("keys").alias("by"))
    return pairs.where("decided").select("a", "b", "overlap", F.lit("sketch").alias("by")).unionByName(found)
