"""Distillation losses over ARRAY<DOUBLE> logits, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbers import let

IGNORED = -100


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Linear in the vocabulary: the largest logit and the sum of exponentials are bound once per row."""
    scaled = F.transform(logits, lambda v: v.cast("double") / temperature)
    total = lambda p: F.log(F.aggregate(p["z"], F.lit(0.0), lambda acc, v: acc + F.exp(v - p["top"])))
    shifted = lambda p: let(p["top"] + total(p), lambda low: F.transform(p["z"], lambda v: v - low))
    return let(scaled, lambda z: let(F.struct(z.alias("z"), F.array_max(z).alias("top")), shifted))


def kd_divergence(student: Column, teacher: Column, temperature: float) -> Column:
    """T**2 times KL(teacher || student) at a position."""
    s, t = log_softmax(student, temperature), log_softmax(teacher, temperature)
    return F.aggregate(F.zip_with(s, t, lambda a, b: F.exp(b) * (b - a)), F.lit(0.0), lambda acc, v: acc + v) * temperature**2


def cross_entropy(logits: Column, label: Column, smoothing: float = 0.0) -> Column:
    """Negative log likelihood of a label, smoothed over the vocabulary; null where the label is ignored."""
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v) / F.size(p)
    loss = let(log_softmax(logits), lambda p: -(1 - smoothing) * F.get(p, label.cast("int")) - smoothing * mean(p))
    return F.when(label != IGNORED, loss)


def combined_loss(positions: DataFrame, *keys: str, temperature: float = 2.0, weight_sft: float = 0.5, weight_kd: float = 0.5, smoothing: float = 0.0) -> DataFrame:
    """sft, kd and total loss per group of positions (student, teacher, label), over those not ignored.

    A weight of 0 leaves the teacher unread.  A group without a label has no sft loss and a kd loss of 0.
    """
    if temperature <= 0 or min(weight_sft, weight_kd) < 0 or weight_sft + weight_kd == 0 or not 0 <= smoothing < 1:
        raise ValueError("temperature must be positive, weights not negative nor both 0, smoothing in [0, 1)")
    on = F.col("label") != IGNORED
    sft = cross_entropy(F.col("student"), F.col("label"), smoothing)
    kd = F.when(on, kd_divergence(F.col("student"), F.col("teacher"), temperature)) if weight_kd else F.lit(None).cast("double")
    sums = positions.select(*keys, sft.alias("sft"), kd.alias("kd"), on.cast("long").alias("on")).groupBy(*keys).agg(
        F.avg("sft").alias("sft_loss"), (F.coalesce(F.sum("kd"), F.lit(0.0)) / F.greatest(F.sum("on"), F.lit(1))).alias("kd_loss")
    )
    return sums.withColumn("total_loss", F.coalesce(F.col("sft_loss"), F.lit(0.0)) * weight_sft + F.col("kd_loss") * weight_kd)


def shifted_labels(positions: DataFrame, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Position i predicts the label of i + 1; the last position of a sequence goes."""
    nxt = F.lead("label").over(Window.partitionBy(seq).orderBy(pos))
    return positions.withColumn("label", nxt).where(F.col("label").isNotNull())


def pad_batch(examples: DataFrame, batch: str, pad_id: int) -> DataFrame:
    """input_ids, attention_mask and labels right-padded to the longest of their batch."""
    longest = examples.groupBy(batch).agg(F.max(F.size("input_ids")).alias("longest"))
    short = F.col("longest") - F.size("input_ids")
    padded = {c: F.concat(c, F.array_repeat(F.lit(v).cast("int"), short)) for c, v in (("input_ids", pad_id), ("attention_mask", 0), ("labels", IGNORED))}
    return examples.join(longest, batch).withColumns(padded).drop("longest")


def training_example(prompt_ids: Column, full_ids: Column) -> Column:
    """STRUCT<input_ids, attention_mask, labels>: the prompt, which must begin the full ids, is not learned."""
    n = F.size(prompt_ids)
    begins = F.slice(full_ids, F.lit(1), n) == prompt_ids
    ids = F.when(begins, full_ids).otherwise(F.raise_error(F.lit("the prompt does not begin the example")).cast("array<int>"))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(ids, n + 1, F.size(full_ids)))
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), labels.alias("labels"))


def cut_at_eos(ids: Column, eos: int) -> Column:
    """Generated ids up to and with the first end id."""
    at = F.array_position(ids, eos).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), at)).otherwise(ids)


def optimizer_steps(n_examples: int, batch: int, accumulation: int, epochs: float) -> int:
    batches = max(1, n_examples // batch)
    return max(1, int(max(1, batches // accumulation) * epochs))
