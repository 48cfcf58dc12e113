"""Attempts as a stream against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from stepwell.operators import metrics
from stepwell.streaming import attempts

SCHEMA = "task_key string, attempt int, failed boolean, ts timestamp"


def plain(log, retries):
    """(task, attempt, step, failed, outcome) of {task: [failed, ...]}."""
    out = []
    for task, fails in log.items():
        step = tries = 0
        for k, failed in enumerate(fails):
            ends = failed and tries >= retries
            out.append((task, k, step, failed, "failed" if ends else None))
            step, tries = (step, tries + 1) if failed else (step + 1, 0)
            if ends:
                break
    return sorted(out)


def rows_of(log, at=10**9):
    return [(task, k, failed, at) for task, fails in log.items() for k, failed in enumerate(fails)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "task_key string, attempt int, failed boolean, at long").select("task_key", "attempt", "failed", F.timestamp_seconds("at").alias("ts"))


def write(spark, rows, folder):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)


LOG = {f"t{k}": [random.Random(k * 31 + i).random() < 0.3 for i in range(k % 9)] for k in range(40)}


def run(spark, root, **options):
    return attempts.replay(spark, f"{root}/in", frame(spark, []).schema, f"{root}/out", f"{root}/state", **options)


@pytest.mark.parametrize("retries", [0, 1])
def test_any_order_of_arrival_gives_the_same(spark, tmp_path, retries):
    rows = rows_of(LOG)
    rows += rows[::5] + [("t1", None, True, 10**9), (None, 0, False, 10**9)]  # sent twice, or of no task
    random.Random(retries).shuffle(rows)
    for k in range(3):
        write(spark, rows[k::3], f"{tmp_path}/in")
    assert sorted(map(tuple, run(spark, tmp_path, max_retries=retries).collect()), key=str) == sorted(plain(LOG, retries), key=str)
    batch = attempts.in_order_batch(frame(spark, rows), retries)
    assert sorted(map(tuple, batch.collect()), key=str) == sorted(plain(LOG, retries), key=str)


def test_a_restarted_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    log = {"a": [False, True, False, True, True], "b": [False] * 3, "c": [True, True]}
    rows = rows_of(log)
    late = [r for r in rows if r[1] in (0, 2)]  # what others wait for comes after the restart
    write(spark, [r for r in rows if r not in late], f"{tmp_path}/in")
    assert run(spark, tmp_path, max_retries=1).count() == 0
    write(spark, late, f"{tmp_path}/in")
    assert sorted(map(tuple, run(spark, tmp_path, max_retries=1).collect()), key=str) == sorted(plain(log, 1), key=str)
    assert run(spark, tmp_path, max_retries=1).count() == len(plain(log, 1))  # nothing new, nothing twice


def test_silent_tasks_are_given_up(spark, tmp_path):
    base = 10**9
    for k, rows in enumerate([
        [("quiet", 0, False, base), ("gap", 1, False, base), ("done", 0, True, base)],
        [("busy", 0, False, base + 500), ("quiet", 1, False, base + 300)],
        [("busy", 1, False, base + 5000)],
        [("busy", 2, False, base + 5001)],
    ]):
        write(spark, rows, f"{tmp_path}/in")
        got = sorted(map(tuple, run(spark, tmp_path, silence_s=1000, late="10 seconds").collect()), key=str)
    assert [r for r in got if r[4] == "silent"] == [("gap", 0, 0, None, "silent"), ("quiet", 2, 2, None, "silent")]
    assert [r for r in got if r[0] == "busy"] == [("busy", k, k, False, None) for k in range(3)]
    assert ("done", 0, 0, True, "failed") in got


def test_partitions_grow_with_the_attempts(spark, monkeypatch):
    from stepwell.plans import derived
    from stepwell.sources import shared

    monkeypatch.setattr(shared, "ROWS_PER_TASK", 200, raising=False)
    folder = "/root/testdata/sf0.001"
    least = derived.table(spark, folder, "lineitem").count() // 200
    log = derived.attempts(spark, folder)
    for rows in (derived.result_rows(spark, folder), attempts.in_order_batch(log.withColumnRenamed("step_index", "attempt")), metrics.up_to_first_failure(log, ["task_key"], "step_index", F.col("failed")).groupBy("task_key").count()):
        assert rows.rdd.getNumPartitions() >= least > 4


def test_no_attempts(spark):
    assert attempts.in_order_batch(frame(spark, [])).count() == 0
