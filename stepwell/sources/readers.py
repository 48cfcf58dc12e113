"""Scans with explicit schemas; order is always a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checker
from ..schemas import BFCL_ANSWER, BFCL_QUESTION, DEFAULT_TASK_SET, DIVERGENCE, LOSS_LOG, PREPARED, RESULT, STEP
from . import json_arrays


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str, schema: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): the lines of JSON files that have the schema's types, and those that do not, with their file.

    One scan writes both below ``folder``, parted by whether a line is broken, so a
    bad line is neither an error nor a row of nulls, and nothing is read twice.
    """
    parsed = spark.read.schema(f"{schema}, broken_line string").option("columnNameOfCorruptRecord", "broken_line").json(path)
    parsed.withColumns({"file": F.col("_metadata.file_path"), "broken": F.col("broken_line").isNotNull()}).write.partitionBy("broken").parquet(folder)
    whole = spark.read.schema(f"{schema}, broken_line string, file string, broken boolean").parquet(folder)
    return whole.where("not broken").drop("broken_line", "broken", "file"), whole.where("broken").select("file", "broken_line")


def read_layer_results(spark: SparkSession, path: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Layer comparisons, and the lines that are none."""
    return read_lines(spark, path, DIVERGENCE, folder)


def read_loss_log(spark: SparkSession, path: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Loss logs, and the lines that are none."""
    return read_lines(spark, path, LOSS_LOG, folder)


def jsonl_of_text(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """The same from a text column, a row per non-blank line, with its line number."""
    lines = texts.select(F.posexplode(F.split(column, "\n")).alias("line", "json")).where(F.trim("json") != "")
    return lines.select("line", F.from_json("json", schema).alias("r")).select("line", "r.*")


def read_json_arrays(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Files that hold one JSON array each, read by byte ranges, with the file a row came from."""
    return json_arrays.read_json_arrays(spark, glob, schema).drop("at")


def read_examples(spark: SparkSession, questions: str, answers: str) -> DataFrame:
    """Benchmark questions with their ground truth, from two files of JSON lines joined by id; later lines win.

    A line's place in its file is its order; lines that are no JSON have no id and meet nothing.
    """
    lines = lambda path, schema: spark.read.text(path).select(F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord"), F.from_json("value", schema).alias("r")).select("r.*", "ord").where("id is not null")
    asked = lines(questions, BFCL_QUESTION)
    return checker.join_examples(asked.drop("ord"), lines(answers, BFCL_ANSWER))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, RESULT)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Inverse of ``writers.write_results_csv``: empty is null, numbers and booleans are cast, steps parsed."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    value = lambda c: F.nullif(F.col(c), F.lit(""))
    return raw.select(
        "condition", F.coalesce(value("task_set"), F.lit(DEFAULT_TASK_SET)).alias("task_set"), value("chain_length").try_cast("int").alias("chain_length"), "task_id",
        (F.lower("success") == "true").alias("success"), *(value(c).try_cast("int").alias(c) for c in ("num_steps_attempted", "injected_error_at_step", "failure_step_index")),
        value("failure_error_type").alias("failure_error_type"), F.from_json("steps_json", f"array<{STEP}>").alias("steps"),
    )


def read_activations(spark: SparkSession, path: str) -> DataFrame:
    """Vectors stored by layer and stream."""
    return spark.read.parquet(path)


def activation_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Layer and stream of array names such as ``layer3__ffn``."""
    return df.withColumns({"layer": F.regexp_extract(key, r"^layer(\d+)__", 1).try_cast("int"), "stream": F.regexp_extract(key, r"__(\w+)$", 1)})


def read_prefix(spark: SparkSession, path: str, n: int, order: str = "source_index") -> DataFrame:
    """The first rows by an order column, as a pushed filter and not a bare limit."""
    return spark.read.parquet(path).where(F.col(order) < n)


def first_texts(texts: DataFrame, n: int, order: str = "source_index") -> DataFrame:
    return texts.orderBy(order).limit(n).select("text")


def load_tasks(spark: SparkSession, chain_length: int, source: str, path: str | None = None) -> DataFrame:
    """Tasks of one chain length from the synthetic, extended or prepared source."""
    from ..plans.tasks import from_prepared, task_set

    if chain_length not in (1, 3, 5):
        raise ValueError(f"no chain length {chain_length}")
    if source in ("synthetic", "synthetic_ext"):
        return task_set(spark, "c" if source == "synthetic" else "x").where(F.col("chain_length") == chain_length)
    if source in ("corpus_train", "corpus_test"):
        if path is None:
            raise FileNotFoundError(f"{source} needs the path of its prepared split")
        return from_prepared(read_jsonl(spark, path, PREPARED)).where(F.col("chain_length") == chain_length)
    raise ValueError(f"unknown source {source}")
