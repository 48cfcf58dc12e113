"""Evaluation runs: conditions, task sets and seeds through the operators, and a worker's job."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators import checker, metrics
from ..sources import writers
from ..streaming import episodes

log = logging.getLogger(__name__)


def evaluate_condition(condition: str, task_sets: dict[str, tuple[DataFrame, dict]], make_model: Callable, max_batch: int = 1, retries: int = episodes.RETRIES) -> DataFrame:
    """Result rows of one model over named task sets (tasks, tools).

    make_model makes a model of a task or, for ``max_batch`` above 1, without an
    argument, one that answers many histories at once.
    """
    parts = []
    for name, (tasks, tools) in task_sets.items():
        if max_batch > 1:
            states = episodes.run_tasks_batched(tasks, make_model, tools, max_batch, retries)
        else:
            states = episodes.run_tasks(tasks, make_model, tools, retries)
        parts.append(metrics.result_rows(states, F.lit(condition), F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def evaluate_grid(models: dict[str, Callable], seeds: list[int], task_sets: dict[str, tuple[DataFrame, dict]]) -> DataFrame:
    """Rows of every condition, seed and task set; models: condition -> (seed -> make_model)."""
    parts = [evaluate_condition(c, task_sets, make(seed)).withColumn("seed", F.lit(seed)) for c, make in models.items() for seed in seeds]
    return reduce(DataFrame.unionByName, parts)


def run_calls(examples: DataFrame, make_model: Callable[[], Callable], condition: str, category: str, max_batch: int = 64) -> DataFrame:
    """Single-turn calls: each example's prompt is answered in batches and scored; examples: id, function, user_message, truth."""
    asked = examples.select("id", "truth", checker.build_prompt(F.col("function"), F.col("user_message")).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            prompts = batch.column(2).to_pylist()
            said = [text for k in range(0, len(prompts), max_batch) for text in model(prompts[k : k + max_batch])]
            if len(said) != len(prompts):
                raise ValueError(f"{len(said)} answers to {len(prompts)} prompts")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string())], names=["id", "truth", "output"])

    return checker.score_calls(asked.mapInArrow(run, "id string, truth string, output string"), F.lit(condition), F.lit(category))


def summarize_calls(rows: DataFrame) -> DataFrame:
    """Accuracy per condition, and how many answers held no proper call."""
    return rows.groupBy("condition").agg(F.avg(F.col("success").cast("double")).alias("accuracy"), F.count("error_type").alias("n_malformed"))


def write_evaluation(rows: DataFrame, perplexity: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """Writes rows and the summary with each condition's perplexity; returns the summary.

    The rows are kept while the three outputs are written, so models answer once.
    """
    kept = rows.persist(StorageLevel.DISK_ONLY)
    try:
        summary = metrics.with_perplexity(metrics.summary_by_condition_and_chain_length(kept), perplexity)
        writers.write_eval_outputs(kept, summary, folder, force)
    finally:
        kept.unpersist()
    return rows.sparkSession.read.json(f"{folder}/eval_summary")


def run_job(spark: SparkSession, job: dict, train: Callable[[dict], str], evaluate: Callable[[dict, str], DataFrame], clean: Callable[[str], None], root: str, send_log: Callable[[dict], None] | None = None) -> None:
    """A worker's job: train, evaluate the checkpoint, write the rows under the job's keys, delete the checkpoint.

    The checkpoint goes even if the evaluation fails; a loss log that cannot be
    sent is only a warning.
    """
    checkpoint = train(job)
    try:
        tagged = evaluate(job, checkpoint).withColumns({k: F.lit(v) for k, v in job.items()})
        writers.write_partition(tagged, root, *job)
    finally:
        clean(checkpoint)
    if send_log:
        try:
            send_log(job)
        except OSError as e:
            log.warning("loss log of %s not sent: %s", job, e)
