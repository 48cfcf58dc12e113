"""Cutting a plan by a table in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "/tmp/checkpoints"
ROWS_PER_TASK = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session may leave it unset."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or LOCAL_DIR).rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new path below it, one for each call."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as written once to the shared folder: what follows reads files, so nothing is computed again."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many partitions as ``n_rows`` rows need, so a task's share does not grow with the table.

    Joins, groups and windows by these keys follow without another shuffle.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-n_rows // ROWS_PER_TASK)), *keys)
