"""Job lists, resumption and configuration overrides."""

from __future__ import annotations

import copy
import json
import time
from collections.abc import Callable
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import striped

# Names of the compared conditions.
CONDITIONS = ("base", "sft_only", "distilled")
CONTROLS = ("sft_early", "sft_ls", "self_distill", "distilled_8b", "self_distill_small", "distilled_olmo", "self_distill_olmo", "distilled_olmo7", "self_distill_olmo7")


def parse_jobs(specs: DataFrame, names: list[str], spec: str = "spec") -> DataFrame:
    """Rows of colon-separated parts from comma lists; a malformed part fails the query, blanks are skipped.

    names: one per part; a part called ``seed`` or ``n_tools`` is an integer.
    """
    part = F.explode(F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != ""))
    split = specs.select(part.alias("job")).select("job", F.split("job", ":").alias("p"))
    whole = F.lit(True)
    for i, n in enumerate(names):
        if n in ("seed", "n_tools"):
            whole &= F.coalesce(F.get("p", F.lit(i)).rlike(r"^\d+$"), F.lit(False))
        else:
            whole &= F.coalesce(F.get("p", F.lit(i)) != "", F.lit(False))
    checked = split.withColumn("p", F.when((F.size("p") == len(names)) & whole, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("malformed job: "), F.col("job"))).cast("array<string>")))
    value = lambda i, n: F.get("p", F.lit(i)).try_cast("int") if n in ("seed", "n_tools") else F.get("p", F.lit(i))
    return checked.select(*(value(i, n).alias(n) for i, n in enumerate(names)))


def sweep_name(sweep: Column) -> Column:
    """STRUCT<name, n_examples> of 'name@nK' (n_examples null without a suffix)."""
    n = F.regexp_extract(sweep, r"@n([1-9]\d*)$", 1)
    return F.struct(F.regexp_replace(sweep, r"@n[1-9]\d*$", "").alias("name"), F.when(n != "", n.cast("int")).alias("n_examples"))


def fold_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def split_key(key: Column, n: int = 3) -> Column:
    return F.split(key, ":", n)


def pending(jobs: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a finished result."""
    return jobs.join(finished.select(*keys), keys, "left_anti")


def dealt(jobs: DataFrame, order: str, n_workers: int, index: int) -> DataFrame:
    """Every n-th job of an ordered list."""
    return striped(jobs, order, n_workers, index)


def result_path(root: str, kind: str, **keys) -> str:
    """One folder per job key, in partition style, so that a job overwrites only itself."""
    return "/".join([root.rstrip("/"), kind, *(f"{k}={v}" for k, v in keys.items() if v is not None)])


def stage_file(seed: Column, *parts: Column, root: str = "runs/v2-seed") -> Column:
    """Path of a job's result below its seed's run; parts that are null are left out."""
    return F.concat(F.lit(root), seed.cast("string"), F.lit("/results/stages/"), F.concat_ws("_", *parts), F.lit(".json"))


def log_file(seed: Column, *parts: Column, root: str = "runs/v2-seed") -> Column:
    """Path of a job's loss log beside its result."""
    return F.concat(F.lit(root), seed.cast("string"), F.lit("/results/training_logs/"), F.concat_ws("_", *parts), F.lit(".jsonl"))


def local_log(condition: Column, sweep: Column, folder: str = "results/training_logs") -> Column:
    """Path of the log that a training run writes itself: its condition, and its sweep if it has one."""
    return F.concat(F.lit(f"{folder.rstrip('/')}/"), F.concat_ws("-", condition, sweep), F.lit(".jsonl"))


def run_jobs(jobs: DataFrame, finished: DataFrame, keys: list[str], run: Callable[[dict], None], budget_s: float = float("inf"), clock: Callable[[], float] = time.monotonic) -> dict[str, list[dict]]:
    """Does the pending jobs in the order of their keys while the time budget lasts; a failure is let through.

    A job list is a dimension of some hundred rows.  Returns what was ran, skipped
    (it had a result) and deferred (the budget was used up).
    """
    rows = lambda df: [r.asDict() for r in df.orderBy(*keys).collect()]
    todo, end = rows(pending(jobs, finished, keys)), clock() + budget_s
    started = takewhile(lambda job: clock() < end, todo)
    ran = [job for job in started if run(job) is None or job]
    return {"ran": ran, "skipped": rows(jobs.join(finished.select(*keys), keys, "left_semi")), "deferred": todo[len(ran) :]}


def set_path(config: dict, path: str, value) -> dict:
    """A copy of a nested config with one existing entry replaced; an unknown path is a KeyError."""
    out = copy.deepcopy(config)
    node = out
    *above, last = path.split(".")
    for k in above:
        node = node[k]
    if last not in node:
        raise KeyError(path)
    node[last] = value
    return out


def resolve_config(base: dict, sweep: dict[str, object] | None = None, condition: dict[str, object] | None = None, seed: int | None = None) -> dict:
    """Base, then the sweep's overrides, then the condition's, then the seed."""
    out = base
    for overrides in (sweep or {}, condition or {}):
        for path, value in overrides.items():
            out = set_path(out, path, value)
    if seed is not None:
        out = {**out, "seed": seed}
    return out


def mark_stage(spark: SparkSession, root: str, stage: str, finished_at: float) -> None:
    """Appends a stage's marker once its work is written."""
    spark.createDataFrame([(stage, finished_at)], "stage string, finished_at double").coalesce(1).write.mode("append").json(f"{root}/_stages")


def finished_stages(spark: SparkSession, root: str) -> list[str]:
    from pyspark.errors import AnalysisException

    try:
        return [r["stage"] for r in spark.read.schema("stage string, finished_at double").json(f"{root}/_stages").select("stage").distinct().collect()]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def run_stage(spark: SparkSession, root: str, stage: str, work: Callable[[], None], clock: Callable[[], float] = time.time) -> bool:
    """Does a stage's work once; True if it did it now."""
    if stage in finished_stages(spark, root):
        return False
    work()
    mark_stage(spark, root, stage, clock())
    return True


def as_json(value) -> str:
    return json.dumps(value, indent=2, sort_keys=True)
