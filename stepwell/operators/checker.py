"""Single-turn calls against multi-valued ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import answer
from ..functions.values import accepted
from .sampling import last_wins


def join_examples(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with an answer that holds exactly one ground truth; the last of duplicate answers counts.

    questions: id, question (turns of messages), function, ord; answers: id,
    ground_truth (array of JSON), ord.
    """
    last = last_wins(answers, "id", F.col("ord")).where(F.size("ground_truth") == 1).select("id", F.get("ground_truth", F.lit(0)).alias("truth"))
    users = F.transform(F.filter(F.flatten("question"), lambda m: m["role"] == "user"), lambda m: m["content"])
    return questions.withColumn("user_message", F.array_join(users, "\n")).join(last, "id")


def build_prompt(functions: Column, user_message: Column) -> Column:
    """System and user message from the function list."""
    lines = F.array_join(F.transform(functions, lambda f: F.concat(F.lit("- "), f["name"], F.lit(": "), f["description"], F.lit(" Parameters: "), f["parameters"])), "\n")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", F.concat(F.lit("You can call these functions:\n"), lines)), message("user", user_message))


def score_calls(outputs: DataFrame, condition: Column, category: Column) -> DataFrame:
    """One flat row per (id, output, truth)."""
    parsed = outputs.select("id", answer(F.col("output")).alias("p"), F.try_parse_json("truth").alias("t"))
    ok = F.coalesce((F.col("p.kind") == "call") & F.col("t").isNotNull() & accepted(F.col("p.value"), F.col("t")), F.lit(False))
    return parsed.select(
        condition.alias("condition"), F.concat(F.lit("bfcl_"), category).alias("task_set"), F.col("id").alias("task_id"), ok.alias("success"), F.col("p.name").alias("tool_name"),
        F.when(F.col("p.kind") == "malformed", "MalformedCallError").alias("error_type"),
    )


def accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.col("success").cast("double")).alias("accuracy"))


def agreement(rerun: DataFrame, recorded: DataFrame) -> DataFrame:
    """Compared tasks, same success and same sequence of tool names; the last recorded duplicate counts."""
    names = lambda c: F.transform(c, lambda s: s["tool_name"])
    nth = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("ord")))
    b = recorded.select("task_id", F.col("success").alias("b_success"), names(F.col("steps")).alias("b_tools"), "ord").withColumn("nth", nth).where("nth = 1")
    a = rerun.select("task_id", "success", names(F.col("steps")).alias("a_tools"))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return a.join(b, "task_id").agg(F.count("*").alias("n_compared"), one(F.col("success") == F.col("b_success")).alias("same_success"), one(F.col("a_tools").eqNullSafe(F.col("b_tools"))).alias("same_tools"))
