"""Quality rules with thresholds that adapt to each language and source.

Every text gets a few integer rates (per ten thousand).  Their distributions
are kept as mergeable log-linear histograms, one per (language, source, rate):
a sketch is a set of (bucket, count) rows, merging two is adding counts, so
Spark's partial aggregation builds them without moving a row of text, and no
sketch has more than a few hundred buckets.  A value lies in a bucket whose
width is at most 1/64 of it.  A group's fences are ``q1 - reach`` and ``q3 +
reach``; reach is read from the group's own sketch, the largest of FENCE times the
quartile distance, TAIL times the distance from the third quartile to the group's
tail, and a small floor.  The tail is the TAIL_PERCENT quantile of what is not
absurd (not above ``q3 + FENCE * max(q3 - q1, prior)``), so that junk, of which a
group may hold a lot, does not widen its own fence.  Fences replace fixed cutoffs
and are joined back to the texts.  A group with fewer than MIN_GROUP texts uses the
merged sketch of its language, or of all texts where that is small too.

Defined cases: a null text has no words; a text without words, or that fails
the base rules, is not kept; null language or source is a group of its own; a
very long text is measured whole; repeated rows are counted and returned each; an
empty table has no row.  Extra columns are ignored, and kept by
``filter_documents`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .doc_stats import COUNTS, doc_counts
from .staging import stage
from .text import blocks

#: Rate: (numerator, denominator, prior spread, whether values below the lower fence fail).
RATES = {
    "mean_word": ("word_chars", "n_words", 4000, True),
    "symbols": ("n_symbols", "n_words", 250, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1500, False),
    "repeats": ("n_repeat_words", "n_words", 1000, False),
    "upper": ("n_upper", "word_chars", 400, False),
    "bangs": ("n_bangs", "n_words", 500, False),
}
FENCE, TAIL, TAIL_PERCENT = 4, 6, 98
#: The least reach of a fence is FENCE times the prior spread divided by this.
FLOOR = 2
MIN_GROUP = 200
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bucket_of(value: np.ndarray) -> np.ndarray:
    """Bucket of a value >= 0: itself below 128, else 64 buckets for each power of two."""
    shift = np.maximum(np.frexp(np.maximum(value, 1).astype(np.float64))[1] - 7, 0)
    return shift * 64 + (value >> shift)


def _value_of(bucket):
    """The least value of a bucket, as a column expression."""
    power = F.greatest(F.floor(bucket / 64).cast("int") - 1, F.lit(0))
    return (bucket - power * 64) * F.pow(F.lit(2.0), power).cast("long")


def text_rates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns, COUNTS, and a bucket ``b_<rate>`` for each rate, per row."""
    names = (*COUNTS, *(f"b_{r}" for r in RATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(0)):
                c = doc_counts(data, offsets)
                for r, (a, b, _, _) in RATES.items():
                    c[f"b_{r}"] = bucket_of(c[a] * 10_000 // np.maximum(c[b], 1))
                own = [batch.column(k + 1)[i:j] for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c[n].astype(np.int64)) for n in names)], names=[*(f"k{k}" for k in range(len(keep))), *names])

    picked = docs.select(F.col(text).alias("text"), *(F.col(k).alias(f"k{n}") for n, k in enumerate(keep)))
    schema = ", ".join([*(f"k{n} {picked.schema[n + 1].dataType.simpleString()}" for n in range(len(keep))), *(f"{n} long" for n in names)])
    return picked.mapInArrow(run, schema).withColumnsRenamed({f"k{n}": k for n, k in enumerate(keep)})


def sketches(rates: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rate, bucket, n): the mergeable sketches, texts without words left out."""
    stack = ", ".join(f"'{r}', b_{r}" for r in RATES)
    return (
        rates.where("n_words > 0")
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.expr(f"stack({len(RATES)}, {stack}) as (rate, bucket)"))
        .groupBy("lang", "source", "rate", "bucket")
        .agg(F.count("*").alias("n"))
    )


def _prior(rate: str = "rate"):
    return F.coalesce(*(F.when(F.col(rate) == r, F.lit(x[2])) for r, x in RATES.items()))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and rate: number of values, first and third quartile and tail, each a bucket's least value."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rate")  # the buckets of one sketch
    ranked = merged.withColumns({"value": _value_of(F.col("bucket")), "upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    first = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("value"))).over(group)
    placed = ranked.withColumns({"q1": first(1), "q3": first(3)})
    absurd = F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), _prior())
    sane = placed.withColumn("sane", F.sum(F.when(F.col("value") <= absurd, F.col("n"))).over(group))
    tail = F.min(F.when(F.col("upto") * 100 >= F.col("sane") * TAIL_PERCENT, F.col("value")))
    return sane.groupBy(*keys, "rate").agg(F.max("total").alias("n"), F.max("q1").alias("q1"), F.max("q3").alias("q3"), tail.alias("tail"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): ``lo_<rate>`` and ``hi_<rate>``."""
    own, lang, every = quantiles(sketch, ["lang", "source"]), quantiles(sketch, ["lang"]), quantiles(sketch, [])
    named = lambda df, p, keys: df.select(*(F.col(k).alias(f"{p}_{k}") for k in keys), *(F.col(c).alias(f"{p}_{c}") for c in ("rate", "n", "q1", "q3", "tail")))
    o, g, e = named(own, "o", ["lang", "source"]), named(lang, "g", ["lang"]), named(every, "e", [])
    joined = o.join(g, F.col("o_lang").eqNullSafe(F.col("g_lang")) & (F.col("o_rate") == F.col("g_rate"))).join(e, F.col("o_rate") == F.col("e_rate"))
    pick = lambda c: F.when(F.col("o_n") >= MIN_GROUP, F.col(f"o_{c}")).when(F.col("g_n") >= MIN_GROUP, F.col(f"g_{c}")).otherwise(F.col(f"e_{c}"))
    reach = F.greatest((pick("q3") - pick("q1")) * FENCE, (pick("tail") - pick("q3")) * TAIL, F.floor(_prior("o_rate") * FENCE / FLOOR))
    long = joined.select(F.col("o_lang").alias("t_lang"), F.col("o_source").alias("t_source"), F.col("o_rate").alias("rate"), (pick("q1") - reach).alias("lo"), (pick("q3") + reach).alias("hi"))
    at = lambda c, r: F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{c}_{r}")
    return long.groupBy("t_lang", "t_source").agg(*(at(c, r) for r in RATES for c in ("lo", "hi")))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def verdict():
    """Whether all rates lie within the fences of the row's group."""
    ok = F.lit(True)
    for r, (a, b, _, low) in RATES.items():
        value = F.floor(F.col(a) * 10_000 / F.greatest(F.col(b), F.lit(1)))
        ok &= value <= F.col(f"hi_{r}")
        if low:
            ok &= value >= F.col(f"lo_{r}")
    return F.coalesce(ok, F.lit(False))


def apply_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, kept and the first rate out of its fences.

    The one pass over the texts writes the counts to the shared folder; the
    sketches and the joined filter both read that narrow table.
    """
    rates = stage(spark, text_rates(docs), "rates")
    limits = thresholds(sketches(rates))
    joined = rates.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return joined.select("doc_id", "lang", "source", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept"))


def rate_values(text):
    """STRUCT of n_words, n_repeat_words, and the value and bucket of each rate, as a column."""
    names = ("n_words", "n_repeat_words", *RATES, *(f"b_{r}" for r in RATES))

    @F.arrow_udf("struct<" + ", ".join(f"{n}: bigint" for n in names) + ">")
    def values(texts: pa.Array) -> pa.Array:
        parts = {n: [np.zeros(0, np.int64)] for n in names}
        for _, _, data, offsets in blocks(texts):
            c = doc_counts(data, offsets)
            c |= {r: c[a] * 10_000 // np.maximum(c[b], 1) for r, (a, b, _, _) in RATES.items()}
            c |= {f"b_{r}": bucket_of(c[r]) for r in RATES}
            for n in names:
                parts[n].append(c[n])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(parts[n])) for n in names], names=list(names))

    return values(text)


def filter_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Two passes: one adds up the sketches, one decides row by row beside the
    fences of the row's group, so no text is shuffled unless there are so many
    groups that their fences are no small table.
    """
    rated = docs.select("lang", "source", rate_values(F.col("text")).alias("q")).select("lang", "source", "q.*")
    sketch = stage(spark, sketches(rated), "sketch")
    limits = stage(spark, thresholds(sketch), "fences")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # so that no name of a column can clash
    whole = docs.select(row.alias("row"), F.col("lang").alias("lang"), F.col("source").alias("source"), rate_values(F.col("text")).alias("q"))
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    ok = (F.col("q.n_words") >= MIN_WORDS) & (F.col("q.n_repeat_words") * 100 <= F.col("q.n_words") * MAX_REPEAT_PERCENT)
    for r, (_, _, _, low) in RATES.items():
        ok &= F.col(f"q.{r}") <= F.col(f"hi_{r}")
        if low:
            ok &= F.col(f"q.{r}") >= F.col(f"lo_{r}")
    kept = whole.join(limits, same, "left").where(F.coalesce(ok, F.lit(False)))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
