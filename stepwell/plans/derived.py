"""Relations of the engine derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_attempts(spark: SparkSession, sf_dir: str) -> int:
    """How many rows ``attempts`` has at most, from the files' footers."""
    return table(spark, sf_dir, "lineitem").count()


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of episodes before truncation: an order is a task, its lines are steps in a total order.

    Both tables are dealt by task over as many partitions as the lines need, and all that follows by task stays there.
    """
    n_lines = n_attempts(spark, sf_dir)
    lines = spread(table(spark, sf_dir, "lineitem"), n_lines, "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    steps = lines.select(
        F.col("l_orderkey").alias("task_key"), (F.row_number().over(order) - 1).alias("step_index"), (F.col("l_returnflag") == "R").alias("failed"), (F.col("l_linestatus") == "O").alias("recovered"),
        F.element_at(F.array(*(F.lit(x) for x in ("ToolArgumentError", "ToolExecutionError", "WrongToolError", "MalformedCallError", "OddError"))), (F.pmod("l_suppkey", F.lit(5)) + 1).cast("int")).alias("error_type"),
        (F.pmod("l_partkey", F.lit(4)) != 0).alias("matched"), (F.pmod("l_partkey", F.lit(3)) != 0).alias("compared"),
    )
    orders = spread(table(spark, sf_dir, "orders"), n_lines, "o_orderkey").select(F.col("o_orderkey").alias("task_key"), F.col("o_orderpriority").alias("condition"))
    return steps.join(orders, "task_key")


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows: steps up to the first failure, nested per task."""
    steps = attempts(spark, sf_dir)
    task = Window.partitionBy("task_key")
    seen = steps.withColumns({"first": F.min(F.when(F.col("failed"), F.col("step_index"))).over(task), "chain_length": F.count("*").over(task)})
    step = F.struct(
        F.col("step_index").cast("int").alias("step_index"), F.lit("tool").alias("tool_name"), (~F.col("failed")).alias("succeeded"), (~F.col("failed") & F.col("recovered")).alias("recovered_from_error"),
        F.lit(None).cast("string").alias("error"), F.when(F.col("failed"), F.col("error_type")).alias("error_type"), F.when(F.col("compared"), F.col("matched")).alias("arguments_match"),
    )
    nested = seen.where("first is null or step_index <= first").groupBy("task_key", "condition", "chain_length").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    injected = F.when(F.pmod("task_key", F.lit(4)) == 0, F.pmod(F.floor(F.col("task_key") / 4), F.col("chain_length"))).cast("int")
    success = F.forall("steps", lambda s: s["succeeded"]) & (F.size("steps") == F.col("chain_length"))
    last = F.element_at("steps", -1)
    return nested.select(
        "condition", F.when(F.pmod("task_key", F.lit(2)) == 0, "seen_tools").alias("task_set"), F.col("chain_length").cast("int").alias("chain_length"), F.concat(F.lit("t"), F.pmod("task_key", F.lit(50)), F.lit("-"), "task_key").alias("task_id"),
        success.alias("success"), F.size("steps").alias("num_steps_attempted"), injected.alias("injected_error_at_step"), F.when(~success, last["step_index"]).alias("failure_step_index"), F.when(~success, last["error_type"]).alias("failure_error_type"), "steps", "task_key",
    )


#: The same in SQL: one row per step that was attempted, with its task's columns.
STEPS_SQL = """
lines as (
    select l_orderkey as task_key, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity, l_discount) - 1 as step_index,
        l_returnflag = 'R' as failed, l_linestatus = 'O' as recovered, l_suppkey, l_partkey
    from lineitem
), cut as (
    select *, count(*) over (partition by task_key) as chain_length,
        min(case when failed then step_index end) over (partition by task_key) as first_failed
    from lines
), steps as (
    select task_key, o_orderpriority as condition, chain_length, step_index, not failed as succeeded, (not failed and recovered) as recovered_from_error,
        case when failed then (['ToolArgumentError', 'ToolExecutionError', 'WrongToolError', 'MalformedCallError', 'OddError'])[l_suppkey % 5 + 1] end as error_type,
        case when l_partkey % 3 <> 0 then l_partkey % 4 <> 0 end as arguments_match,
        case when task_key % 4 = 0 then (task_key // 4) % chain_length end as injected,
        case when task_key % 2 = 0 then 'seen_tools' else 'unseen_tools' end as task_set
    from cut join orders on o_orderkey = task_key where first_failed is null or step_index <= first_failed
), tasks as (
    select task_key, any_value(condition) as condition, any_value(task_set) as task_set, any_value(chain_length) as chain_length, bool_and(succeeded) as success,
        count(*) as n_steps, count(*) filter (where succeeded) as n_ok, count(*) filter (where succeeded and not recovered_from_error) as n_clean,
        count(*) filter (where arguments_match) as n_matched, count(arguments_match) as n_compared,
        count(*) filter (where step_index = injected) as n_injected, count(*) filter (where step_index = injected and succeeded) as n_recovered, max(error_type) as failure_error_type
    from steps group by task_key
)
"""


def raw_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of chats whose right parse is known from the events; every drop reason occurs."""
    e = table(spark, sf_dir, "events")
    k = F.pmod("event_id", F.lit(10))
    call = F.concat(F.lit('<functioncall> {"name": "'), "event_type", F.lit('", "arguments": \''), "props", F.lit("'} <|endoftext|>"))
    noted = F.concat(F.lit('<functioncall> {"name": "'), "event_type", F.lit('", "note": "a <functioncall> comes", "arguments": \''), "props", F.lit("'} <|endoftext|>"))
    goal = F.concat(F.lit("USER: please log "), "event_type", F.lit("\n\n\nASSISTANT: "))
    chat = (
        F.when(k == 0, F.concat(goal, F.lit("no call today")))
        .when(k == 1, F.concat(goal, call, F.lit("\n\n\nUSER: again\n\n\nASSISTANT: "), call))
        .when(k == 2, F.concat(goal, F.lit('<functioncall> {"name": "broken"')))
        .when(k == 3, F.concat(F.lit("ASSISTANT: "), call))
        .when(k == 4, F.concat(F.lit("USER:  \nASSISTANT: "), call))
        .when(k == 5, F.concat(goal, F.lit('<functioncall> {"name": "'), "event_type", F.lit('", "arguments": {"other": 1}}')))
        .when(k == 6, F.concat(goal, noted))  # a tag inside a block is part of its text
        .otherwise(F.concat(goal, call))
    )
    return e.select(F.col("event_id").alias("source_index"), chat.alias("chat"))


def event_tools(spark: SparkSession) -> DataFrame:
    """Signatures of the event types that count as selected tools."""
    return spark.sql("select * from values ('click', array('k')), ('view', array('k')), ('purchase', array('k')), ('never_called', array('k')) as t(tool, canonical_args)")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired outcomes of documents: quality and toxic as two conditions, (source, lang) as template."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("template"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


def activations(spark: SparkSession, sf_dir: str, start: int, width: int) -> DataFrame:
    """Embeddings as activations: layer = label, a side takes some of the dimensions; samples by their place in the layer."""
    e = table(spark, sf_dir, "embeddings")
    vec = F.transform(F.slice("embedding", start, width), lambda v: v.cast("double"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return e.select(F.col("label").cast("int").alias("layer"), F.lit("ffn").alias("stream"), nth.alias("sample_id"), vec.alias("vec"))
