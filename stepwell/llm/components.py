"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import stage


def _jumped(spark: SparkSession, parent: DataFrame, keys: list[str]) -> DataFrame:
    """(u, v) with every v a root: the parent of the parent takes its place until none has one."""
    while True:
        above = parent.select(*keys, F.col("u").alias("v"), F.col("v").alias("w"))
        step = stage(spark, parent.join(above, [*keys, "v"], "left").select(*keys, "u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")), "parents")
        parent = step.select(*keys, "u", "v")
        if step.where("moved").isEmpty():
            return parent


def components(spark: SparkSession, edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, node, component) of every node of ``edges`` (keys, u, v), the component being its least node.

    ``keys`` tell graphs apart that are solved together.  In a round every node
    hooks to its least neighbour below it, trees are flattened in log(depth)
    steps, and edges are carried over to the roots; edges that join no different
    roots go.  A hub meets its neighbours only in aggregations and joins.
    """
    keys = list(keys)
    tidy = lambda df, u, v: df.select(*keys, F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    now = stage(spark, tidy(edges, F.col("u"), F.col("v")), "edges")
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        roots = _jumped(spark, now.groupBy(*keys, "u").agg(F.min("v").alias("v")), keys)
        rounds.append(roots)
        at = lambda c: roots.select(*keys, F.col("u").alias(c), F.col("v").alias(f"of_{c}"))  # noqa: B023, E731
        met = now.join(at("u"), [*keys, "u"], "left").join(at("v"), [*keys, "v"], "left")
        now = stage(spark, tidy(met, F.coalesce("of_u", "u"), F.coalesce("of_v", "v")), "edges")
    if not rounds:
        return now.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))

    def composed(later: DataFrame, earlier: DataFrame) -> DataFrame:
        top = later.select(*keys, F.col("u").alias("v"), F.col("v").alias("w"))
        return earlier.join(top, [*keys, "v"], "left").select(*keys, "u", F.coalesce("w", "v").alias("v")).unionByName(later)

    found = reduce(composed, reversed(rounds))
    own = found.select(*keys, F.col("v").alias("u"), "v").distinct()
    return stage(spark, found.unionByName(own).select(*keys, F.col("u").alias("node"), F.col("v").alias("component")), "labels")
