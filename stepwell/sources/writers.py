"""Sinks.  Nulls are kept; existing results are only replaced when asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_TASK_SET


def write_jsonl(df: DataFrame, path: str, force: bool = False) -> None:
    """A folder of JSON lines; an existing one is an error unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").option("ignoreNullFields", False).json(path)


def write_results_csv(rows: DataFrame, path: str, force: bool = False) -> None:
    flat = rows.select(
        "condition", F.coalesce("task_set", F.lit(DEFAULT_TASK_SET)).alias("task_set"), "chain_length", "task_id", "success", "num_steps_attempted", "injected_error_at_step",
        "failure_step_index", "failure_error_type", F.to_json("steps", {"ignoreNullFields": "false"}).alias("steps_json"),
    )
    flat.write.mode("overwrite" if force else "errorifexists").option("header", True).option("escape", '"').csv(path)


def write_activations(vectors: DataFrame, path: str) -> str:
    vectors.write.mode("overwrite").partitionBy("layer", "stream").parquet(path)
    return path


def ablation_path(path: str, n_tools: int | None) -> str:
    """The path of a run over fewer tools, beside the full one's."""
    if n_tools is None:
        return path
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}_ntools{n_tools}.{suffix}" if dot else f"{path}_ntools{n_tools}"


def write_partition(df: DataFrame, path: str, *keys: str) -> None:
    """Replaces only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def write_eval_outputs(rows: DataFrame, summary: DataFrame, folder: str, force: bool = False) -> None:
    write_jsonl(rows, f"{folder}/eval_results", force)
    write_results_csv(rows, f"{folder}/eval_results_csv", force)
    write_jsonl(summary, f"{folder}/eval_summary", force)
