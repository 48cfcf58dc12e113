"""Scores of result rows: every rate is one aggregation, null over nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import py_round, rate
from ..functions.tool_tables import PROTOCOL_ERRORS, TOOL_ERRORS
from ..schemas import DEFAULT_TASK_SET
from .sampling import columns_of, whole_row


def _steps_where(test) -> Column:
    return F.size(F.filter(F.coalesce("steps", F.array()), test)).cast("long")


def step_counts() -> dict[str, Column]:
    """Per-row counts that all rates add up, so steps are never exploded for them."""
    injected = F.get("steps", F.col("injected_error_at_step"))
    return {
        "n_steps": _steps_where(lambda s: F.lit(True)),
        "n_ok": _steps_where(lambda s: s["succeeded"]),
        "n_clean": _steps_where(lambda s: s["succeeded"] & ~s["recovered_from_error"]),
        "n_matched": _steps_where(lambda s: F.coalesce(s["arguments_match"], F.lit(False))),
        "n_compared": _steps_where(lambda s: s["arguments_match"].isNotNull()),
        "n_injected": injected.isNotNull().cast("long"),
        "n_recovered": F.coalesce(injected["succeeded"], F.lit(False)).cast("long"),
    }


def chain_success_rate() -> Column:
    return F.avg(F.col("success").cast("double"))


def rates() -> list[Column]:
    """Aggregates over ``step_counts`` columns."""
    total = lambda c: F.sum(c)
    return [
        F.count("*").alias("n_tasks"),
        chain_success_rate().alias("full_chain_success_rate"),
        rate(total("n_ok"), total("n_steps")).alias("per_step_success_rate"),
        rate(total("n_clean"), total("n_steps")).alias("clean_step_success_rate"),
        rate(total("n_recovered"), total("n_injected")).alias("recovery_rate"),
        rate(total("n_matched"), total("n_compared")).alias("argument_accuracy"),
    ]


def summarize(rows: DataFrame, *keys: str) -> DataFrame:
    """One row of rates per group (one in all without keys)."""
    return rows.withColumns(step_counts()).groupBy(*keys).agg(*rates())


def error_category(error_type: Column) -> Column:
    return F.when(error_type.isin(*TOOL_ERRORS), "tool_execution").when(error_type.isin(*PROTOCOL_ERRORS), "protocol").otherwise("unknown")


def error_breakdown(rows: DataFrame, *keys: str) -> DataFrame:
    """Failed rows by the error of their last step."""
    return rows.where(~F.col("success") & F.col("failure_error_type").isNotNull()).groupBy(*keys, "failure_error_type").agg(F.count("*").alias("n"))


def error_category_breakdown(rows: DataFrame, *keys: str) -> DataFrame:
    """The same, rolled up to categories."""
    return error_breakdown(rows, *keys).groupBy(*keys, error_category(F.col("failure_error_type")).alias("category")).agg(F.sum("n").alias("n"))


def _as_map(counts: DataFrame, keys: list[str], name: str, key: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))


def with_task_set(rows: DataFrame) -> DataFrame:
    """Older rows without a task set belong to the default one."""
    if "task_set" not in rows.columns:
        return rows.withColumn("task_set", F.lit(DEFAULT_TASK_SET))
    return rows.withColumn("task_set", F.coalesce("task_set", F.lit(DEFAULT_TASK_SET)))


def summary_by_condition_and_chain_length(rows: DataFrame) -> DataFrame:
    """Rates and both error maps by (condition, task_set, chain_length), ordered."""
    keys = ["condition", "task_set", "chain_length"]
    rows = with_task_set(rows)
    empty = F.create_map().cast("map<string,bigint>")
    errors = _as_map(error_breakdown(rows, *keys), keys, "error_breakdown", "failure_error_type")
    kinds = _as_map(error_category_breakdown(rows, *keys), keys, "error_category_breakdown", "category")
    joined = summarize(rows, *keys).join(errors, keys, "left").join(kinds, keys, "left")
    return joined.withColumns({c: F.coalesce(c, empty) for c in ("error_breakdown", "error_category_breakdown")}).orderBy(*keys)


def error_rows(summary: DataFrame) -> DataFrame:
    """A summary's error maps as rows: condition, task_set, chain_length, kind (``type`` or ``category``), error, n."""
    keys = ["condition", "task_set", "chain_length"]
    one = lambda c, kind: summary.select(*keys, F.lit(kind).alias("kind"), F.explode(c).alias("error", "n"))
    return one("error_breakdown", "type").unionByName(one("error_category_breakdown", "category"))


def step_success_by_position(rows: DataFrame, *keys: str) -> DataFrame:
    steps = rows.select(*keys, F.explode("steps").alias("s"))
    return steps.groupBy(*keys, F.col("s.step_index").alias("step_index")).agg(F.avg(F.col("s.succeeded").cast("double")).alias("success_rate"))


def success_by_chain_length(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chain_length").agg(chain_success_rate().alias("success_rate")).orderBy("chain_length")


def describe(rows: DataFrame, *keys: str, task_sets: tuple[str, ...] = ()) -> DataFrame:
    """Number of rows and a success rate that is 0, not null, over nothing; of some task sets only, if they are named."""
    rows = with_task_set(rows).where(F.col("task_set").isin(*task_sets)) if task_sets else rows
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), (F.coalesce(F.sum(F.col("success").cast("long")), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("success_rate"))


def described(description: DataFrame, what: str = "tasks") -> DataFrame:
    """``describe`` as the line that a worker logs."""
    return description.withColumn("text", F.format_string(f"%d {what}, success %.3f", "n_rows", py_round(F.col("success_rate"), 3)))


def merged_error_totals(summary: DataFrame, *keys: str) -> DataFrame:
    """Sums the error maps of a summary over its other keys."""
    return summary.select(*keys, F.explode("error_breakdown").alias("error_type", "n")).groupBy(*keys, "error_type").agg(F.sum("n").alias("n"))


def up_to_first_failure(steps: DataFrame, keys: list[str], order: str, failed: Column) -> DataFrame:
    """The steps of each episode up to and with its first failed one; steps without a key belong to none."""
    own = [f"k{i}" for i in range(len(keys))]
    rows = steps.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.col(order).alias("at"), failed.alias("failed"), whole_row(steps).alias("row"))
    for k in own:
        rows = rows.where(F.col(k).isNotNull())
    first = F.min(F.when(F.col("failed"), F.col("at"))).over(Window.partitionBy(*own))
    kept = rows.withColumn("first", first).where(F.col("first").isNull() | (F.col("at") <= F.col("first")))
    key = dict(zip(keys, own))  # so that what follows by key knows where it lies
    return kept.select(*(F.col(key[c]).alias(c) if c in key else of_row for c, of_row in zip(steps.columns, columns_of("row", steps))))


def result_rows(states: DataFrame, condition: Column, task_set: Column, keep_transcript: bool = False) -> DataFrame:
    """Result rows of episode states (task_id, chain_length, success, steps, messages, injected_error_at_step)."""
    last = F.when(~F.col("success") & (F.size("steps") > 0), F.element_at("steps", -1))
    transcript = F.filter("messages", lambda m: m["role"] != "system") if keep_transcript else F.lit(None).cast("array<struct<role: string, content: string>>")
    return states.select(
        condition.alias("condition"), task_set.alias("task_set"), "chain_length", "task_id", "success", F.size("steps").alias("num_steps_attempted"), "injected_error_at_step",
        last["step_index"].alias("failure_step_index"), last["error_type"].alias("failure_error_type"), "steps", transcript.alias("transcript"),
    )


def with_perplexity(summary: DataFrame, perplexity: DataFrame) -> DataFrame:
    """A condition's perplexity beside its rates; null where there is none."""
    return summary.join(perplexity.select("condition", "perplexity"), "condition", "left")


def pooled_perplexity(nll: DataFrame, *keys: str) -> DataFrame:
    """exp of summed loss over summed tokens of (nll, n_tokens) rows with two tokens or more."""
    used = nll.where("n_tokens >= 2")
    return used.groupBy(*keys).agg(F.exp(rate(F.sum("nll"), F.sum("n_tokens"))).alias("perplexity"))


def perplexity_of_tokens(tokens: DataFrame, *keys: str, text: str = "text_id", place: str = "place", max_length: int = 512) -> DataFrame:
    """Pooled perplexity from one row per token (text, place from 0, nll of predicting it), texts cut at ``max_length`` tokens.

    The first token of a text is predicted from nothing and does not count, so a
    text of one token has none; a group whose texts are all that short is an error.
    """
    within = (F.col(place) >= 1) & (F.col(place) < max_length)
    pooled = tokens.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.sum(F.when(within, F.col("nll"))).alias("nll"), F.count(F.when(within, 1)).alias("n_tokens"), F.count_if(F.col(place) == 1).alias("n_texts"))
    checked = F.when(F.col("n_tokens") > 0, F.exp(F.try_divide("nll", "n_tokens"))).otherwise(F.raise_error(F.lit("no text has two tokens")).cast("double"))
    return pooled.select(*keys, checked.alias("perplexity"), "n_tokens", "n_texts")


def loss_log_summary(log: DataFrame, *keys: str, order: str = "step") -> DataFrame:
    """Number of entries, first and last losses, and how many losses are not finite."""
    odd = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False)).cast("long")
    ends = [f(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"{c.split('_')[0]}_{n}") for c in ("sft_loss", "kd_loss") for n, f in (("first", F.min_by), ("last", F.max_by))]
    return log.groupBy(*keys).agg(F.count("*").alias("n_logged"), *ends, F.sum(odd("sft_loss") + odd("kd_loss")).alias("nonfinite"))


def generation_stats(outputs: DataFrame, *keys: str) -> DataFrame:
    """Least, upper-middle and largest number of tokens, and sums, from counts per value: no group gathers its rows."""
    own = Window.partitionBy(*keys)
    each = outputs.groupBy(*keys, "n_tokens").agg(F.count("*").alias("n"))
    upto = each.withColumns({"upto": F.sum("n").over(own.orderBy("n_tokens")), "size": F.sum("n").over(own)})
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("size") / 2), F.col("n_tokens")))
    return upto.groupBy(*keys).agg(F.min("n_tokens").alias("least"), middle.alias("median"), F.max("n_tokens").alias("most"), F.sum(F.col("n_tokens") * F.col("n")).alias("total"))
