"""Corpus preparation: free-text chats to labelled records, counters and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import strip, word_count
from ..functions.parsing import ParseCalls, find_calls, last_user_before
from .sampling import most_common

REASONS = ("parse_error", "zero_calls", "multi_call", "tool_not_selected", "non_canonical_args", "no_user_turn", "empty_user_goal", "ok")


def parse_corpus(raw: DataFrame) -> DataFrame:
    """source_index, chat, calls (null if a block does not parse), error."""
    return raw.select("source_index", "chat", find_calls(F.col("chat")).alias("p")).select("source_index", "chat", "p.calls", "p.error")


def call_rows(raw: DataFrame) -> DataFrame:
    """source_index, nth, name, arguments, arg_keys, style, char_offset, error: a row for each call of each text."""
    return ParseCalls(raw.select(F.col("source_index").cast("long").alias("source_index"), "chat").asTable())


def classify(parsed: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds reason (the first that applies) and the record's columns.

    tools: (tool, canonical_args sorted), a dimension as small as a registry.
    """
    call = F.when(F.size("calls") == 1, F.get("calls", F.lit(0)))
    first = parsed.withColumn("call", call).withColumn("goal", last_user_before(F.col("chat"), F.col("call.char_offset")))
    joined = first.join(F.broadcast(tools.select("tool", "canonical_args")), F.col("call.name") == F.col("tool"), "left")
    reason = (
        F.when(F.col("calls").isNull(), "parse_error")
        .when(F.size("calls") == 0, "zero_calls")
        .when(F.size("calls") > 1, "multi_call")
        .when(F.col("tool").isNull(), "tool_not_selected")
        .when(F.array_sort("call.arg_keys") != F.col("canonical_args"), "non_canonical_args")
        .when(F.col("goal").isNull(), "no_user_turn")
        .when(F.col("goal") == "", "empty_user_goal")
        .otherwise("ok")
    )
    return joined.withColumn("reason", reason).drop("canonical_args")


def records(classified: DataFrame) -> DataFrame:
    """The prepared records of the rows that are ok."""
    ok = classified.where("reason = 'ok'")
    return ok.select(
        F.concat(F.lit("corpus-"), F.col("source_index")).alias("task_id"), F.lit(1).alias("chain_length"), F.col("goal").alias("user_goal"), F.array("tool").alias("expected_tool_sequence"),
        F.lit(None).cast("int").alias("injected_error_at_step"), F.col("call.arguments").alias("arguments"), F.col("call.style").alias("arguments_style"), "source_index", "tool",
    )


def reason_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("reason").agg(F.count("*").alias("n"))


def kept_per_tool(kept: DataFrame, tools: DataFrame) -> DataFrame:
    """Kept rows of every tool, 0 where there are none."""
    counted = kept.groupBy("tool").agg(F.count("*").alias("n"))
    return tools.select("tool").join(counted, "tool", "left").select("tool", F.coalesce("n", F.lit(0)).alias("n"))


def stats_row(parsed: DataFrame, classified: DataFrame, splits: DataFrame, tools: DataFrame, n_min: int = 500, n_max: int = 1000) -> DataFrame:
    """One row: totals, drop reasons, kept per tool, the most frequent names, sizes of the splits."""
    as_map = lambda df, k: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias("m"))
    reasons = as_map(reason_counts(classified), "reason").withColumnRenamed("m", "drop_reasons")
    kept = as_map(kept_per_tool(classified.where("reason = 'ok'"), tools), "tool").withColumnRenamed("m", "kept_per_tool")
    calls = parsed.select("source_index", F.explode("calls").alias("c")).select("source_index", F.col("c.name").alias("tool"))
    top = most_common(calls, "tool", "source_index").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "first_seen", "tool"))).alias("top_tools"))
    sizes = splits.agg(F.count("*").alias("n_total"), F.count(F.when(F.col("split") == "train", 1)).alias("n_train"), F.count(F.when(F.col("split") == "test", 1)).alias("n_test"))
    rows = classified.agg(F.count("*").alias("n_raw"))
    names = calls.agg(F.countDistinct("tool").alias("n_distinct_tools"))
    out = rows
    for one in (names, reasons, kept, top, sizes):  # tables of one row each
        out = out.withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out.withColumn("within_bounds", F.col("n_total").between(n_min, n_max))


def stats_rows(stats: DataFrame) -> DataFrame:
    """The stats row as (kind, name, n) rows."""
    of_map = lambda c: stats.select(F.lit(c).alias("kind"), F.explode(c).alias("name", "n"))
    top = stats.select(F.explode("top_tools").alias("t")).select(F.lit("top_tools").alias("kind"), F.col("t.tool").alias("name"), F.negative("t.minus_n").alias("n"))
    sizes = stats.select(F.explode(F.create_map(*(x for c in ("n_raw", "n_distinct_tools", "n_total", "n_train", "n_test") for x in (F.lit(c), F.col(c).cast("long"))), F.lit("within_bounds"), F.col("within_bounds").cast("long"))).alias("name", "n"))
    return of_map("drop_reasons").unionByName(of_map("kept_per_tool")).unionByName(top).unionByName(sizes.select(F.lit("size").alias("kind"), "name", "n"))


def general_texts(texts: DataFrame, min_words: int = 10) -> DataFrame:
    """Stripped texts of ``min_words`` words or more, with their index."""
    stripped = strip(F.col("text"))
    return texts.select(stripped.alias("text"), "source_index", word_count(stripped).alias("n_words")).where(F.col("n_words") >= min_words)


def canonical(tool_keys: Column) -> Column:
    return F.array_sort(tool_keys)
