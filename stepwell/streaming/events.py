"""Event-time windows over the events table (an addition to the evaluation operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_event_time(events: DataFrame) -> DataFrame:
    """Watermarks need an instant, so the stored local time is read as UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per window and type; ``late`` sets the watermark of a stream."""
    timed = with_event_time(events)
    if late:
        timed = timed.withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    timed = with_event_time(events)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def stream_of(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as an unbounded table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def process_new(stream: DataFrame, work, checkpoint: str):
    """Runs ``work(batch, batch_id)`` once per new batch and returns when all there is was processed.

    The checkpoint remembers what is done, so a restarted run goes on where the
    last one stopped; ``work`` must be idempotent by batch_id.
    """
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def running_losses(entries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Per run: entries, last step and non-finite losses of a streamed loss log."""
    timed = entries.withWatermark("ts", late)
    odd = F.coalesce(F.isnan("sft_loss") | (F.abs("sft_loss") == float("inf")), F.lit(False))
    return timed.groupBy("run").agg(F.count("*").alias("n_logged"), F.max("step").alias("last_step"), F.sum(odd.cast("long")).alias("nonfinite"))
