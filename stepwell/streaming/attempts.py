"""Attempts of tasks as a stream: put in order, numbered by step, cut at the failure that ends a task.

An attempt is (task_key, attempt, failed, ts); attempts of a task are numbered from
0 and may arrive in any order, in any batch, more than once.  The step that an
attempt is at is the number of successes before it.  A step may fail and be tried
again ``max_retries`` times; one more failure ends the task, and what comes after
is not part of it.

``in_order`` keeps a small record for each task: the number of the attempt that
comes next, its step and tries, and the attempts that wait for one before them.
Tasks are hashed into buckets, whose records are one state with one timer: calls of
the state store, not rows, are what costs, and there are so many of buckets alone.  A
task that stays silent for ``silence_s`` seconds of event time after its last attempt is
given up: a row with outcome ``silent`` says how far it came, and its state goes;
so does, without a row, that of a task that has ended.  ``in_order_batch`` gives the
rows of the same attempts as one table, by windows.

Defined cases: a null ``failed`` counts as a failure; rows with a null key or
number are left out; a repeated attempt counts once, as it came first (in a batch:
as a failure if one of the repeats is one); a task whose first attempt never comes
has only its silent row; an empty stream has no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.metrics import up_to_first_failure

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "tasks binary, timer bigint"


class InOrder(StatefulProcessor):
    """The tasks of one bucket: task key -> (next, step, tries, ended, deadline, waiting attempts)."""

    def __init__(self, max_retries: int, silence_ms: int):
        self.max_retries, self.silence_ms = max_retries, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _STATE)

    def _read(self) -> tuple[dict, int]:
        found = self.bucket.get()
        return (pickle.loads(bytes(found[0])), found[1]) if found is not None else ({}, 0)

    def _keep(self, tasks: dict, timer: int) -> None:
        """Writes the state; ``timer`` is the one that is set (0: none), and the next is the earliest deadline."""
        due = min((t[4] for t in tasks.values()), default=0)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        if tasks:
            self.bucket.update((pickle.dumps(tasks, pickle.HIGHEST_PROTOCOL), due))
        else:
            self.bucket.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        tasks, timer = self._read()
        arrived: dict = {}
        for row in rows:
            arrived.setdefault(row[0], []).append(row)
        soonest = timerValues.getCurrentWatermarkInMs() + 1
        for task, own in arrived.items():
            then, step, tries, ended, deadline, waiting = tasks.get(task) or (0, 0, 0, False, 0, {})
            latest = deadline - self.silence_ms if deadline else 0
            for _, attempt, failed, at_ms, *_ in own:
                latest = max(latest, at_ms)
                if not ended and attempt >= then:
                    waiting.setdefault(attempt, failed)
            while not ended and then in waiting:
                failed = waiting.pop(then)
                ended = failed and tries >= self.max_retries
                yield Row(task_key=task, attempt=then, step=step, failed=failed, outcome="failed" if ended else None)
                step, tries = (step, tries + 1) if failed else (step + 1, 0)
                then += 1
            if latest + self.silence_ms != deadline:
                deadline = max(latest + self.silence_ms, soonest)
            tasks[task] = (then, step, tries, ended, deadline, {} if ended else waiting)
        self._keep(tasks, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tasks, _ = self._read()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for task in [k for k, t in tasks.items() if t[4] <= now]:
            then, step, _, ended, _, _ = tasks.pop(task)
            if not ended:
                yield Row(task_key=task, attempt=then, step=step, failed=None, outcome="silent")
        self._keep(tasks, 0)  # the timer that went off is gone

    def close(self) -> None:
        pass


def in_order(attempts: DataFrame, max_retries: int = 0, silence_s: int = 3600, late: str = "1 hour", buckets: int = 64) -> DataFrame:
    """(task_key, attempt, step, failed, outcome) of a stream of attempts (task_key, attempt, failed, ts).

    late: how far event times may lag behind the latest one.  The session needs the
    RocksDB state store (``use_rocksdb``).  buckets: some thousand tasks each; a
    checkpoint is bound to their number.
    """
    timed = attempts.where(F.col("task_key").isNotNull() & F.col("attempt").isNotNull()).select("task_key", F.col("attempt").cast("int").alias("attempt"), F.coalesce("failed", F.lit(True)).alias("failed"), F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    kind = timed.schema["task_key"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("task_key"), F.lit(buckets)).alias("bucket")
    return timed.select("task_key", "attempt", "failed", "at_ms", "ts", bucket).groupBy("bucket").transformWithState(InOrder(max_retries, 1000 * silence_s), f"task_key {kind}, attempt int, step int, failed boolean, outcome string", "append", "EventTime")


def in_order_batch(attempts: DataFrame, max_retries: int = 0) -> DataFrame:
    """(task_key, attempt, step, failed, outcome) of a table of attempts: those with all others before them, up to the failure that ends a task."""
    each = attempts.where(F.col("task_key").isNotNull() & F.col("attempt").isNotNull()).groupBy("task_key", F.col("attempt").cast("int").alias("attempt")).agg(F.bool_or(F.coalesce("failed", F.lit(True))).alias("failed"))
    task = Window.partitionBy("task_key").orderBy("attempt")  # the attempts of one task
    before = task.rowsBetween(Window.unboundedPreceding, -1)
    whole = each.where(F.col("attempt") >= 0).withColumn("place", F.row_number().over(task) - 1).where(F.col("place") == F.col("attempt")).drop("place")
    ok = ~F.col("failed")
    steps = whole.withColumns({"step": F.coalesce(F.sum(ok.cast("int")).over(before), F.lit(0)).cast("int"), "passed": F.coalesce(F.max(F.when(ok, F.col("attempt"))).over(before), F.lit(-1))})
    ended = steps.withColumn("ends", F.col("failed") & (F.col("attempt") - F.col("passed") > max_retries)).drop("passed")
    kept = up_to_first_failure(ended, ["task_key"], "attempt", F.col("ends"))
    return kept.select("task_key", "attempt", "step", "failed", F.when(F.col("ends"), "failed").alias("outcome"))


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that keeps the states of tasks on disk and their changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def replay(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, files_per_trigger: int = 1, **options) -> DataFrame:
    """What ``in_order`` has written of the attempts in a folder's files; run again, it goes on where it stopped."""
    use_rocksdb(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    found = in_order(stream, **options)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)
