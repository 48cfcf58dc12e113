"""Registered queries: each applies an operator to whole tables; SQL gives the same result independently where it can."""

from __future__ import annotations

import contextlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import losses, numbers, stats, tools, values
from ..functions.parsing import parse_output
from ..operators import checker, distinct, frequent, gram, joins, layers, metrics, prepare, reports, sampling
from ..sources import caches, commits, json_arrays, readers, shared, writers
from ..streaming import attempts as in_order
from ..streaming import episodes, events
from ..schemas import LOSS_LOG
from . import jobs, runs
from .derived import STEPS_SQL, activations, attempts, event_tools, n_attempts, paired, raw_chats, result_rows, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_RATES = """count(*)::bigint as n_tasks, round(avg(success::int::double), 9) as full_chain_success_rate,
    round(sum(n_ok)::double / nullif(sum(n_steps), 0), 9) as per_step_success_rate, round(sum(n_clean)::double / nullif(sum(n_steps), 0), 9) as clean_step_success_rate,
    round(sum(n_recovered)::double / nullif(sum(n_injected), 0), 9) as recovery_rate, round(sum(n_matched)::double / nullif(sum(n_compared), 0), 9) as argument_accuracy"""


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_RATE_NAMES = ("full_chain_success_rate", "per_step_success_rate", "clean_step_success_rate", "recovery_rate", "argument_accuracy")


@query(f"with {STEPS_SQL.strip()} select condition, task_set, chain_length::int as chain_length, {_RATES} from tasks group by 1, 2, 3")
def summary_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.with_task_set(result_rows(spark, sf_dir))
    return _rounded(metrics.summarize(rows, "condition", "task_set", "chain_length"), *_RATE_NAMES)


@query()
def summary_with_error_maps(spark, sf_dir):
    return metrics.summary_by_condition_and_chain_length(result_rows(spark, sf_dir))


@query(f"with {STEPS_SQL.strip()} select condition, step_index::int as step_index, round(avg(succeeded::int::double), 9) as success_rate from steps group by 1, 2")
def step_success_by_position(spark, sf_dir):
    return _rounded(metrics.step_success_by_position(result_rows(spark, sf_dir), "condition"), "success_rate")


@query(f"with {STEPS_SQL.strip()} select condition, failure_error_type, count(*)::bigint as n from tasks where not success group by 1, 2")
def error_breakdown(spark, sf_dir):
    return metrics.error_breakdown(result_rows(spark, sf_dir), "condition")


@query(f"""with {STEPS_SQL.strip()} select condition, case when failure_error_type in ('ToolExecutionError', 'ToolArgumentError', 'ToolTimeoutError') then 'tool_execution'
    when failure_error_type in ('ProtocolError', 'MalformedCallError', 'UnknownToolError', 'WrongToolError') then 'protocol' else 'unknown' end as category, count(*)::bigint as n from tasks where not success group by 1, 2""")
def error_category_breakdown(spark, sf_dir):
    return metrics.error_category_breakdown(result_rows(spark, sf_dir), "condition")


@query(f"with {STEPS_SQL.strip()} select chain_length::int as chain_length, round(avg(success::int::double), 9) as success_rate from tasks group by 1")
def success_by_chain_length(spark, sf_dir):
    return _rounded(metrics.success_by_chain_length(result_rows(spark, sf_dir)), "success_rate")


@query(f"with {STEPS_SQL.strip()} select condition, count(*)::bigint as n_rows, round(sum(success::int)::double / greatest(count(*), 1), 9) as success_rate from tasks group by 1")
def describe_results(spark, sf_dir):
    return _rounded(metrics.describe(result_rows(spark, sf_dir), "condition"), "success_rate")


@query(f"with {STEPS_SQL.strip()} select failure_error_type as error_type, count(*)::bigint as n from tasks where not success group by 1")
def merged_error_totals(spark, sf_dir):
    summary = metrics.summary_by_condition_and_chain_length(result_rows(spark, sf_dir))
    return metrics.merged_error_totals(summary.withColumn("all", F.lit(1)), "all").drop("all")


@query("""with s as (select l_orderkey as task_key, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity, l_discount) - 1 as step_index, l_returnflag = 'R' as failed from lineitem where l_orderkey in (select o_orderkey from orders)),
    c as (select *, sum(failed::int) over (partition by task_key order by step_index rows between unbounded preceding and 1 preceding) as b from s)
    select task_key, count(*)::bigint as n_attempted from c where coalesce(b, 0) = 0 group by 1""")
def truncate_at_first_failure(spark, sf_dir):
    kept = metrics.up_to_first_failure(attempts(spark, sf_dir), ["task_key"], "step_index", F.col("failed"))
    return kept.groupBy("task_key").agg(F.count("*").alias("n_attempted"))


_ATTEMPTS = """a as (select l_orderkey as task_key, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity, l_discount) - 1 as attempt, l_returnflag = 'R' as failed from lineitem where l_orderkey in (select o_orderkey from orders)),
    s as (select *, coalesce(sum((not failed)::int) over (partition by task_key order by attempt rows between unbounded preceding and 1 preceding), 0) as step from a),
    t as (select *, row_number() over (partition by task_key, step order by attempt) as nth from s),
    e as (select *, failed and nth > {retries} as ends from t), c as (select *, coalesce(sum(ends::int) over (partition by task_key order by attempt rows between unbounded preceding and 1 preceding), 0) as ended from e)
    select task_key, attempt::int as attempt, step::int as step, failed, case when ends then 'failed' end as outcome from c where ended = 0"""


@query(f"with {_ATTEMPTS.format(retries=1)}")
def attempt_steps(spark, sf_dir):
    """The step each attempt is at, with one retry of a step, as one table."""
    return in_order.in_order_batch(attempts(spark, sf_dir).withColumnRenamed("step_index", "attempt"), 1)


ATTEMPTS_PER_BUCKET = 8_000


@query(f"with k as (with {_ATTEMPTS.format(retries=0)}) select task_key, count(*)::bigint as n_attempted from k group by 1")
def attempts_stream(spark, sf_dir):
    """The same log as a stream of shuffled files, where attempts of a task arrive in any order, cut at the first failure."""
    log = attempts(spark, sf_dir).select("task_key", F.col("step_index").alias("attempt"), "failed", F.timestamp_seconds(F.lit(10**9)).alias("ts"))
    folder = shared.new_folder(spark, "attempts")
    log.repartition(4, F.xxhash64("task_key", "attempt")).write.parquet(f"{folder}/in")
    kept = in_order.replay(spark, f"{folder}/in", log.schema, f"{folder}/out", f"{folder}/state", files_per_trigger=2, buckets=max(64, n_attempts(spark, sf_dir) // ATTEMPTS_PER_BUCKET))
    return kept.groupBy("task_key").agg(F.count("*").alias("n_attempted"))


# Corpus preparation.

_CHATS_SQL = """e as (select event_id as source_index, event_type, json_extract(props, '$.k')::bigint as k, event_id % 10 as m from events),
r as (select *, case when m = 2 then 'parse_error' when m = 0 then 'zero_calls' when m = 1 then 'multi_call' when event_type not in ('click', 'view', 'purchase') then 'tool_not_selected'
    when m = 5 then 'non_canonical_args' when m = 3 then 'no_user_turn' when m = 4 then 'empty_user_goal' else 'ok' end as reason from e)"""


@query("with e as (select event_id as source_index, event_type, json_extract(props, '$.k')::bigint as k, event_id % 10 as m from events) select source_index, event_type as name, case when m = 5 then null else k end as k, case when m = 5 then 'raw_object' else 'string_single_quoted' end as style from e, range(case when m = 1 then 2 when m in (0, 2) then 0 else 1 end)")
def parse_calls(spark, sf_dir):
    calls = prepare.call_rows(raw_chats(spark, sf_dir)).where("error is null")
    return calls.select("source_index", "name", F.get_json_object("arguments", "$.k").cast("long").alias("k"), "style")


def _classified(spark, sf_dir):
    parsed = prepare.parse_corpus(raw_chats(spark, sf_dir))
    return parsed, prepare.classify(parsed, event_tools(spark))


@query(f"with {_CHATS_SQL} select reason, count(*)::bigint as n from r group by 1")
def classify_reasons(spark, sf_dir):
    return prepare.reason_counts(_classified(spark, sf_dir)[1])


@query(f"with {_CHATS_SQL} select source_index, 'please log ' || event_type as user_goal, event_type as tool, k from r where reason = 'ok'")
def prepared_records(spark, sf_dir):
    rec = prepare.records(_classified(spark, sf_dir)[1])
    return rec.select("source_index", "user_goal", "tool", F.get_json_object("arguments", "$.k").cast("long").alias("k"))


@query(f"with {_CHATS_SQL}, c as (select * from e, range(case when m = 1 then 2 when m in (0, 2) then 0 else 1 end)) select event_type as tool, count(*)::bigint as n, min(source_index) as first_seen from c group by 1 order by n desc, first_seen limit 40")
def tool_frequency_top40(spark, sf_dir):
    """Candidates by summaries of the names, which alone are counted."""
    calls = shared.cut(prepare.call_rows(raw_chats(spark, sf_dir)).where("error is null").select(F.col("name").alias("tool"), "source_index"))
    return frequent.most_frequent(calls, "tool", "source_index", 40)


@query("select p_name, n, first_seen from (select p_name, count(*)::bigint as n, min(l_orderkey) as first_seen from lineitem join part on l_partkey = p_partkey group by 1) order by n desc, first_seen, p_name limit 40")
def frequent_parts(spark, sf_dir):
    """The 40 most ordered part names."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return frequent.most_frequent(lines, "p_name", "l_orderkey", 40)


@query(f"with {_CHATS_SQL}, c as (select event_type from e, range(case when m = 1 then 2 when m in (0, 2) then 0 else 1 end)) select count(distinct event_type)::bigint as n, count(*)::bigint as rows from c")
def distinct_tools(spark, sf_dir):
    calls = prepare.call_rows(raw_chats(spark, sf_dir)).where("error is null")
    return distinct.distinct_counts(calls, "name").select("n", "rows")


@query("select l_returnflag, l_linestatus, count(*)::bigint as rows, count(distinct l_orderkey)::bigint as n, count(distinct l_orderkey) = count(*) as \"unique\", true as within from lineitem group by 1, 2")
def distinct_orders(spark, sf_dir):
    """Exact numbers of orders for each status of a line, whether none repeats, and that each lies within the sketch's bounds."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey")
    keys = ["l_returnflag", "l_linestatus"]
    exact = distinct.distinct_counts(lines, "l_orderkey", *keys)
    bounds = distinct.distinct_bounds(lines, "l_orderkey", *keys).select(*keys, "low", "high")
    return exact.join(bounds, keys).select(*keys, "rows", "n", (F.col("n") == F.col("rows")).alias("unique"), F.col("n").between(F.col("low"), F.col("high")).alias("within"))


@query("""with s as (select 'third ' || (l_orderkey % 3) as name, l_orderkey as k from lineitem union all select 'returned ' || l_returnflag, l_orderkey from lineitem),
    d as (select distinct name, k from s), n as (select distinct name from d), m as (select a.name as a, b.name as b from d a join d b on a.k = b.k and a.name < b.name group by 1, 2)
    select x.name as a, y.name as b, m.a is not null as overlap from n x join n y on x.name < y.name left join m on m.a = x.name and m.b = y.name""")
def split_overlaps(spark, sf_dir):
    """Which parts of the orders share one: thirds of the numbers do not, lines of different return flags do."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    sets = F.array(F.concat(F.lit("third "), (F.col("l_orderkey") % 3).cast("string")), F.concat(F.lit("returned "), "l_returnflag"))
    return distinct.overlaps(lines.select("l_orderkey", F.explode(sets).alias("name")), "l_orderkey", "name").drop("by")


@query(f"with {_CHATS_SQL} select t.tool, count(r.source_index)::bigint as n from (values ('click'), ('view'), ('purchase'), ('never_called')) t(tool) left join r on r.event_type = t.tool and reason = 'ok' group by 1")
def kept_per_tool_zero_filled(spark, sf_dir):
    return prepare.kept_per_tool(_classified(spark, sf_dir)[1].where("reason = 'ok'"), event_tools(spark))


@query(f"with {_CHATS_SQL} select t.tool, count(r.source_index)::bigint as n from (values ('click'), ('view'), ('purchase'), ('never_called')) t(tool) left join r on r.event_type = t.tool and reason = 'ok' group by 1 order by n desc, tool limit 4")
def top_n_tools(spark, sf_dir):
    """Four of the four curated tools: the one that is never called counts 0."""
    kept = _classified(spark, sf_dir)[1].where("reason = 'ok'")
    return sampling.top_n(kept.groupBy("tool").agg(F.count("*").alias("n")), "tool", 4, event_tools(spark).select("tool"))


_SPLIT_SQL = f"""with {_CHATS_SQL}, k as (select source_index, event_type as tool, row_number() over (partition by event_type order by md5('42|' || source_index), source_index) as rn, count(*) over (partition by event_type) as n from r where reason = 'ok'),
s as (select source_index, tool, case when rn <= round_even(least(n, 100) * 0.8, 0) then 'train' else 'test' end as split from k where rn <= 100)"""


def _split(spark, sf_dir):
    kept = prepare.records(_classified(spark, sf_dir)[1])
    return sampling.balance_and_split(kept, "tool", "source_index", 100, 0.8, 42)


@query(_SPLIT_SQL + " select source_index, tool, split from s")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("source_index", "tool", "split")


@query(_SPLIT_SQL + " select (count(*) - count(distinct 'corpus-' || source_index))::bigint as n_shared from s")
def split_disjoint(spark, sf_dir):
    s = _split(spark, sf_dir).select("task_id", "split")
    train, test = (s.where(F.col("split") == x).select("task_id") for x in ("train", "test"))
    return train.intersect(test).agg(F.count("*").alias("n_shared"))


@query()
def prepare_stats(spark, sf_dir):
    """Texts are parsed once; what the numbers are counted from is written."""
    parsed = prepare.parse_corpus(raw_chats(spark, sf_dir))
    classified = shared.cut(prepare.classify(parsed, event_tools(spark)).drop("chat"))
    splits = sampling.balance_and_split(prepare.records(classified), "tool", "source_index", 100, 0.8, 42)
    return prepare.stats_row(classified, classified, splits, event_tools(spark))


@query(_SPLIT_SQL + """, c as (select event_type as tool, source_index from e, range(case when m = 1 then 2 when m in (0, 2) then 0 else 1 end)), z as (
    select 'n_raw' as name, (select count(*) from e) as n union all select 'n_distinct_tools', (select count(distinct tool) from c) union all select 'n_total', (select count(*) from s)
    union all select 'n_train', (select count(*) from s where split = 'train') union all select 'n_test', (select count(*) from s where split = 'test') union all select 'within_bounds', (select (count(*) between 500 and 1000)::int from s))
    select 'size' as kind, name, n::bigint as n from z union all select 'drop_reasons', reason, count(*)::bigint from r group by all union all select 'top_tools', tool, count(*)::bigint from c group by all
    union all select 'kept_per_tool', t.tool, count(r.source_index)::bigint from (values ('click'), ('view'), ('purchase'), ('never_called')) t(tool) left join r on r.event_type = t.tool and reason = 'ok' group by all""")
def prepare_stats_rows(spark, sf_dir):
    """All numbers of the stats row, as rows."""
    return prepare.stats_rows(shared.cut(prepare_stats(spark, sf_dir)))


@query("""select conv_id, turn, max_by(text, turn) filter (where role = 'user') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as last_user from conversations""")
def last_user_before(spark, sf_dir):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before).alias("last_user"))


@query("with w as (select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) as n_words from documents) select doc_id as source_index, n_words::bigint as n_words from w where n_words >= 10")
def wordcount_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("source_index"))
    return prepare.general_texts(docs).select("source_index", "n_words")


@query("select doc_id from documents order by md5('42|' || doc_id), doc_id limit 200")
def sample_n(spark, sf_dir):
    return sampling.sample_n(table(spark, sf_dir, "documents"), "doc_id", 200, 42).select("doc_id")


@query("with k as (select doc_id, lang, row_number() over (partition by lang order by md5('7|' || doc_id), doc_id) as rn from documents) select a.doc_id, a.lang, (b.doc_id is not null) as in_smaller from k a left join (select doc_id from k where rn <= 5) b on a.doc_id = b.doc_id where a.rn <= 20")
def nested_subsample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    large, small = (sampling.subsample(docs, "lang", "doc_id", k, 7) for k in (20, 5))
    return large.join(small.select("doc_id", F.lit(True).alias("in_smaller")), "doc_id", "left").withColumn("in_smaller", F.coalesce("in_smaller", F.lit(False)))


@query("with o as (select event_id, row_number() over (order by event_id) - 1 as place, count(*) over () as n from events) select event_id from o where place in (select floor(i * n / 100) from range(100) t(i), (select count(*) as n from events))")
def evenly_spaced(spark, sf_dir):
    return sampling.evenly_spaced(table(spark, sf_dir, "events").select("event_id"), "event_id", 100)


@query("with o as (select event_id, row_number() over (order by event_id) - 1 as place from events) select event_id from o where place % 4 = 1")
def striped_jobs(spark, sf_dir):
    return sampling.striped(table(spark, sf_dir, "events").select("event_id"), "event_id", 4, 1)


_LINE_ORDER = "l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity, l_discount"
_LINES = "l_orderkey l_partkey l_suppkey l_linenumber l_shipdate l_extendedprice l_quantity l_discount".split()


@query(f"select l_orderkey, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by {', '.join(c + ' desc' for c in _LINE_ORDER.split(', '))}) as rn from lineitem) where rn = 1")
def last_wins_dedup(spark, sf_dir):
    return sampling.last_wins(table(spark, sf_dir, "lineitem").select(*_LINES), "l_orderkey", *map(F.col, _LINE_ORDER.split(", "))).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"select l_orderkey, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as rn from lineitem) where rn = 1")
def first_wins_dedup(spark, sf_dir):
    return sampling.first_wins(table(spark, sf_dir, "lineitem").select(*_LINES), "l_orderkey", *map(F.col, _LINE_ORDER.split(", "))).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query("with o as (select o_orderkey, row_number() over (order by md5('42|3|' || o_orderkey), o_orderkey::varchar) - 1 as place, count(*) over () as n from orders) select o_orderkey, (place // 64)::bigint as batch from o where place // 64 < n // 64")
def epoch_batches(spark, sf_dir):
    return sampling.epoch_batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 42, 3, 64).select("o_orderkey", "batch")


# Joins and sets.


@query("select count(*)::bigint as n_compared, sum((quality <> toxic)::int)::bigint as differing from labels join documents using (doc_id)")
def paired_disagreement(spark, sf_dir):
    p = paired(spark, sf_dir)
    return p.agg(F.count("*").alias("n_compared"), F.sum((F.col("quality") != F.col("toxic")).cast("long")).alias("differing"))


@query(f"with {STEPS_SQL.strip()}, b as (select * from tasks where task_key % 3 <> 0) select count(*)::bigint as n_compared, (count(*) filter (where task_key % 5 <> 0))::bigint as same_success, (count(*) filter (where task_key % 7 <> 0 or n_steps = 1))::bigint as same_tools from b")
def rerun_agreement(spark, sf_dir):
    rows = result_rows(spark, sf_dir)
    changed = rows.where("task_key % 3 <> 0").withColumn("success", F.when(F.pmod("task_key", F.lit(5)) == 0, ~F.col("success")).otherwise(F.col("success")))
    changed = changed.withColumn("steps", F.when(F.pmod("task_key", F.lit(7)) == 0, F.slice("steps", 1, 1)).otherwise(F.col("steps")))
    recorded = changed.withColumn("ord", F.lit(1)).unionByName(rows.where("task_key % 3 = 1").withColumn("success", ~F.col("success")).withColumn("ord", F.lit(0)))
    n = n_attempts(spark, sf_dir)  # each side is dealt by task once, with what is compared alone
    return checker.agreement(*(shared.spread(side.select("task_id", "success", "steps.tool_name", *own), n, "task_id").withColumn("steps", F.transform("tool_name", lambda t: F.struct(t.alias("tool_name")))) for side, own in ((rows, []), (recorded, ["ord"]))))


@query("select label, round(exp(sum(abs(embedding[1]::double)) / sum(len(embedding))), 6) as perplexity from embeddings group by 1")
def pooled_perplexity(spark, sf_dir):
    nll = table(spark, sf_dir, "embeddings").select("label", F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("nll"), F.size("embedding").alias("n_tokens"))
    return _rounded(metrics.pooled_perplexity(nll, "label"), "perplexity", digits=6)


@query("with p as (select label as condition, round(exp(sum(abs(embedding[1]::double)) / sum(len(embedding))), 6) as perplexity from embeddings where label < 5 group by 1), c as (select distinct label as condition from embeddings) select c.condition, p.perplexity from c left join p using (condition)")
def perplexity_left_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "condition")
    nll = e.where("condition < 5").select("condition", F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("nll"), F.size("embedding").alias("n_tokens"))
    return metrics.with_perplexity(e.select("condition").distinct(), _rounded(metrics.pooled_perplexity(nll, "condition"), "perplexity", digits=6))


@query("select n_nationkey, n_name from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9900)")
def pending_jobs_anti(spark, sf_dir):
    done = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return jobs.pending(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), done, ["n_nationkey"])


@query("select n_nationkey, n_name from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal > 0)")
def known_semi(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(known, "n_nationkey", "left_semi")


@query("select conv_id::bigint as conv_id, count(*) filter (where role = 'assistant')::bigint as assistant, count(*) filter (where role = 'system')::bigint as system, count(*) filter (where role = 'user')::bigint as \"user\" from conversations group by 1")
def role_pivot(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").pivot("role", ["assistant", "system", "user"]).count().na.fill(0)


@query(f"with {STEPS_SQL.strip()} select condition, chain_length::int as chain_length, round(avg(success::int::double), 9) as success_rate, count(*)::bigint as n from tasks group by grouping sets ((condition, chain_length), (condition))")
def grouping_sets_all(spark, sf_dir):
    rows = result_rows(spark, sf_dir)
    sets = rows.groupingSets([[F.col("condition"), F.col("chain_length")], [F.col("condition")]], F.col("condition"), F.col("chain_length"))
    return _rounded(sets.agg(metrics.chain_success_rate().alias("success_rate"), F.count("*").alias("n")), "success_rate")


@query(f"with {STEPS_SQL.strip()} select condition, round(avg(success::int::double), 9) as overall, round(avg(success::int::double) filter (where chain_length in (3, 5)), 9) as c35 from tasks group by 1")
def overall_and_c35(spark, sf_dir):
    ok = F.col("success").cast("double")
    return _rounded(result_rows(spark, sf_dir).groupBy("condition").agg(F.avg(ok).alias("overall"), F.avg(F.when(F.col("chain_length").isin(3, 5), ok)).alias("c35")), "overall", "c35")


@query(f"""with {STEPS_SQL.strip()}, f as (select *, case when failure_error_type in ('ToolExecutionError', 'ToolArgumentError', 'ToolTimeoutError') then 'tool_execution'
    when failure_error_type in ('ProtocolError', 'MalformedCallError', 'UnknownToolError', 'WrongToolError') then 'protocol' else 'unknown' end as category from tasks where not success)
    select condition, task_set, chain_length::int as chain_length, 'type' as kind, failure_error_type as error, count(*)::bigint as n from f group by all
    union all select condition, task_set, chain_length::int, 'category', category, count(*)::bigint from f group by all""")
def summary_error_rows(spark, sf_dir):
    """The error maps of the summary, as rows."""
    return metrics.error_rows(metrics.summary_by_condition_and_chain_length(result_rows(spark, sf_dir)))


@query(f"with {STEPS_SQL.strip()} select condition, count(*)::bigint as n_rows, round(sum(success::int)::double / greatest(count(*), 1), 9) as success_rate from tasks where task_set = 'seen_tools' group by 1")
def describe_seen_tools(spark, sf_dir):
    """The same description over one task set."""
    return _rounded(metrics.describe(result_rows(spark, sf_dir), "condition", task_sets=("seen_tools",)), "success_rate")


@query("""with t as (select conv_id, turn, abs(sin(conv_id * 7 + turn * 3 + unnest(range(length(text))))) as nll, generate_subscripts(range(length(text)), 1) - 1 as place, role from conversations)
    select role, round(exp(sum(nll) filter (where place between 1 and 63) / count(*) filter (where place between 1 and 63)), 6) as perplexity, (count(*) filter (where place between 1 and 63))::bigint as n_tokens, (count(*) filter (where place = 1))::bigint as n_texts from t group by 1""")
def truncated_perplexity(spark, sf_dir):
    """Characters as tokens, texts cut at 64 of them."""
    c = table(spark, sf_dir, "conversations").where(F.length("text") > 0)
    tokens = c.select("role", F.concat_ws("-", "conv_id", "turn").alias("text_id"), "conv_id", "turn", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("place"))
    tokens = tokens.select("role", "text_id", "place", F.abs(F.sin(F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("place"))).alias("nll"))
    return _rounded(metrics.perplexity_of_tokens(tokens, "role", max_length=64), "perplexity", digits=6)


@query("select label, i - 1 as i, round(avg(embedding[i]::double), 6) as m from embeddings, range(1, 65) t(i) group by all")
def mean_pooled(spark, sf_dir):
    """The mean vector of each label's embeddings, a row for each dimension."""
    pooled = layers.mean_pool(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vec")), "label")
    return _rounded(pooled.select("label", F.posexplode("vec").alias("i", "m")), "m", digits=6)


@query("select event_id, event_id % 3 <> 1 and event_id % 5 <> 2 as matches from events")
def arguments_match(spark, sf_dir):
    """Objects with the same names and nearly the same values agree; another value or one name more does not."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    near = F.when(F.col("event_id") % 3 == 1, k + 1).otherwise(k)
    more = F.when(F.col("event_id") % 5 == 2, F.lit(', "z": 0')).otherwise(F.lit(""))
    actual = F.format_string('{"t": " %s ", "k": %d.0}', F.upper("event_type"), k)
    expected = F.concat(F.format_string('{"k": %d, "t": "%s"', near, F.col("event_type")), more, F.lit("}"))
    return e.select("event_id", values.arguments_match_col(actual, expected).alias("matches"))


@query("select o_orderkey, case when o_custkey % 3 = 0 then 12 else (o_custkey % 12 + 1)::int end::int as n_ids from orders")
def ids_cut_at_end(spark, sf_dir):
    """Generated ids up to the first end id; a third of the outputs has none."""
    end = F.when(F.col("o_custkey") % 3 == 0, F.lit(-1)).otherwise(F.pmod("o_custkey", F.lit(12)))
    ids = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(i >= end, F.when(end >= 0, 99).otherwise(i)).otherwise(i))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(losses.cut_at_eos(ids, 99)).alias("n_ids"))


@query("select false as compatible, string_agg(n_name, ',' order by n_name) as differing from nation where n_regionkey = 2")
def tokenizer_fields(spark, sf_dir):
    """Two tokenizers as tables of fields, of which some differ."""
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("field"), F.col("n_nationkey").cast("string").alias("value"), "n_regionkey")
    b = a.select("field", F.when(F.col("n_regionkey") == 2, F.concat("value", F.lit("!"))).otherwise(F.col("value")).alias("value"))
    return joins.tokenizers_agree(a.select("field", "value"), b).select("compatible", F.array_join("differing", ",").alias("differing"))


@query("select p_partkey, p_brand as name, case when p_size % 4 <> 0 then p_size end as n_examples from part")
def sweep_names(spark, sf_dir):
    spec = F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("@n"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", jobs.sweep_name(spec).alias("s")).select("p_partkey", "s.name", "s.n_examples")


# Statistics.


@query("""with c as (select source, count(*) as n, sum(quality) as k from labels join documents using (doc_id) group by 1)
    select source, n::bigint as n, k::bigint as k, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n), 9) as center, round(1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 9) as half from c""")
def wilson_ci(spark, sf_dir):
    counted = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return counted.select("source", "n", F.col("k").cast("long").alias("k"), F.round(w["center"], 9).alias("center"), F.round(w["half"], 9).alias("half"))


@query("""with p as (select lang, quality, 1 - toxic as clean from labels join documents using (doc_id)),
    c as (select lang, count(*) as n, count(*) filter (where quality = 1 and clean = 0) as only_a, count(*) filter (where quality = 0 and clean = 1) as only_b, avg(quality) - avg(clean) as difference from p group by 1)
    select lang, n::bigint as n, only_a::bigint as only_a, only_b::bigint as only_b, round(difference, 9) as difference,
    round(case when only_a + only_b = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0))) from range(least(only_a, only_b) + 1) t(i))) end, 9) as p from c""")
def mcnemar_exact(spark, sf_dir):
    p = paired(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("clean", 1 - F.col("toxic"))
    return _rounded(stats.contrast(p, "quality", "clean", "lang"), "difference", "p")


_TEMPLATE_DRAWS = """with p as (select coalesce(source, '') || '-' || coalesce(lang, '') as template, quality::double as a, (1 - toxic)::double as b from labels join documents using (doc_id)),
    c as (select template, sum(a) as a, sum(b) as b, count(*) as n, row_number() over (order by template) - 1 as i from p group by 1), z as (select count(*) as size from c),
    d as (select draw, ('0x' || substr(md5('11|' || draw || '|' || slot), 1, 8))::bigint % size as i from range(10000) t(draw), z, range(size) s(slot))
    select draw::bigint as draw, round(sum(a) / sum(n) - sum(b) / sum(n), 9) as difference from d join c using (i) group by 1"""


def _template_draws(spark, sf_dir):
    p = paired(spark, sf_dir).withColumn("clean", 1 - F.col("toxic"))
    return stats.template_bootstrap(p, "quality", "clean", "template", 10_000, 11)


@query(_TEMPLATE_DRAWS)
def template_bootstrap(spark, sf_dir):
    return _rounded(_template_draws(spark, sf_dir), "difference")


_INTERVAL_SQL = """select round(quantile_cont(difference, 0.025), 6) as low, round(quantile_cont(difference, 0.975), 6) as high,
    round(least(1.0, 2 * least(avg((difference <= 0)::int), avg((difference >= 0)::int))), 6) as p, round(quantile_cont(difference, 0.95), 6) as upper_bound"""


@query(f"with draws as ({_TEMPLATE_DRAWS}) {_INTERVAL_SQL} from draws")
def bootstrap_interval(spark, sf_dir):
    return _rounded(stats.interval(_rounded(_template_draws(spark, sf_dir), "difference")), "low", "high", "p", "upper_bound", digits=6)


_CROSSED_DRAWS = """with r as (select (doc_id % 5)::int as seed, coalesce(source, '') || '-' || coalesce(lang, '') as template, quality - (1 - toxic) as d from labels join documents using (doc_id)),
    cells as (select seed, template, avg(d::double) as d from r group by 1, 2),
    si as (select seed, row_number() over (order by seed) - 1 as i from (select distinct seed from cells)), ti as (select template, row_number() over (order by template) - 1 as i from (select distinct template from cells)),
    sd as (select draw, seed, count(*) as n_seed from (select draw, ('0x' || substr(md5('5|seed|' || draw || '|' || slot), 1, 8))::bigint % (select count(*) from si) as i from range(6000) t(draw), range((select count(*) from si)) s(slot)) join si using (i) group by 1, 2),
    td as (select draw, template, count(*) as n_template from (select draw, ('0x' || substr(md5('5|template|' || draw || '|' || slot), 1, 8))::bigint % (select count(*) from ti) as i from range(6000) t(draw), range((select count(*) from ti)) s(slot)) join ti using (i) group by 1, 2)
    select draw::bigint as draw, round(sum(d * n_seed * n_template) / sum(n_seed * n_template), 9) as difference from sd join cells using (seed) join td using (draw, template) group by 1"""


def _crossed_draws(spark, sf_dir):
    rows = paired(spark, sf_dir).select(F.pmod("doc_id", F.lit(5)).cast("int").alias("seed"), "template", (F.col("quality") - (1 - F.col("toxic"))).alias("d"))
    return _rounded(stats.crossed_bootstrap(rows, "d", "seed", "template", 6000, 5), "difference")


@query(_CROSSED_DRAWS)
def crossed_bootstrap(spark, sf_dir):
    return _crossed_draws(spark, sf_dir)


@query(f"with draws as ({_CROSSED_DRAWS}) {_INTERVAL_SQL}, quantile_cont(difference, 0.05) > -0.1 and quantile_cont(difference, 0.95) < 0.1 as equivalent from draws")
def crossed_tests(spark, sf_dir):
    """Interval, p, one-sided bound and equivalence within 0.1 of the crossed draws."""
    draws = _crossed_draws(spark, sf_dir)
    found = _rounded(stats.interval(draws), "low", "high", "p", "upper_bound", digits=6)
    return found.crossJoin(stats.equivalent(draws, 0.1))  # two tables of one row


@query("""with c as (select source, count(*) as n, sum(quality) as k from labels join documents using (doc_id) group by 1),
    w as (select source, n, k, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) as center, 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) as half from c)
    select source, printf('%5.1f%%  (%d/%d)  [%.1f-%.1f]', k::double / n * 100, k::bigint, n::bigint, (center - half) * 100, (center + half) * 100) as cell from w""")
def rate_cells(spark, sf_dir):
    """Rates as a report prints them."""
    counted = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    return counted.select("source", stats.cell(F.col("k"), F.col("n")).alias("cell"))


@query("with s as (select event_type, (user_id % 5)::bigint as seed, avg(value) as m from events group by 1, 2) select event_type, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd, count(*)::bigint as n_seeds from s group by 1")
def seed_sd(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("seed", F.pmod("user_id", F.lit(5)))
    return _rounded(stats.seed_sd(rows, "value", "seed", "event_type"), "mean", "sd", digits=6)


@query("""with l as (select user_id, event_id as step, case when event_id % 11 = 0 then null when event_id % 13 = 0 then 'nan'::double else value end as sft_loss, case when event_id % 3 = 0 then null else value / 2 end as kd_loss from events)
    select user_id, count(*)::bigint as n_logged, min_by(sft_loss, step) filter (where sft_loss is not null) as sft_first, max_by(sft_loss, step) filter (where sft_loss is not null) as sft_last,
    min_by(kd_loss, step) filter (where kd_loss is not null) as kd_first, max_by(kd_loss, step) filter (where kd_loss is not null) as kd_last, (count(*) filter (where isnan(sft_loss)))::bigint as nonfinite from l group by 1""")
def loss_log_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sft = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, float("nan")).otherwise(F.col("value"))
    log = e.select("user_id", F.col("event_id").alias("step"), sft.alias("sft_loss"), F.when(F.col("event_id") % 3 != 0, F.col("value") / 2).alias("kd_loss"))
    return metrics.loss_log_summary(log, "user_id")


@query("select event_type, min(user_id)::bigint as least, list_sort(list(user_id))[(count(*) // 2) + 1]::bigint as median, max(user_id)::bigint as most, sum(user_id)::bigint as total from events group by 1")
def generation_stats(spark, sf_dir):
    return metrics.generation_stats(table(spark, sf_dir, "events").withColumnRenamed("user_id", "n_tokens"), "event_type")


# Representations and losses.

#: Both metrics of the rows p (groups {k}, i, x, y) from all pairs of a group.
_PAIRS_SQL = """g as (select {k}, a.i, b.i as j, list_inner_product(a.x, b.x) as x, list_inner_product(a.y, b.y) as y, list_cosine_similarity(a.x, b.x) as s, list_cosine_similarity(a.y, b.y) as t from p a join p b using ({k})),
k as (select {k}, i, j, s, t, x - avg(x) over (partition by {k}, i) - avg(x) over (partition by {k}, j) + avg(x) over (partition by {k}) as kx, y - avg(y) over (partition by {k}, i) - avg(y) over (partition by {k}, j) + avg(y) over (partition by {k}) as ky from g),
m as (select {k}, round(sum(kx * ky) / sqrt(sum(kx * kx) * sum(ky * ky)), 6) as cka, round(1 - sum(s * t) filter (where i < j) / (sqrt(sum(s * s) filter (where i < j)) * sqrt(sum(t * t) filter (where i < j))), 6) as cosine_distance from k group by {k})"""
_LAYERS_SQL = "p as (select label as layer, vec_id as i, (embedding::double[])[1:32] as x, (embedding::double[])[33:64] as y from embeddings), " + _PAIRS_SQL.format(k="layer")


def _layer_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda start: F.transform(F.slice("embedding", start, 32), lambda v: v.cast("double"))
    pairs = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("layer"), side(1).alias("x"), side(33).alias("y"))
    return _rounded(layers.similarity_of_all(pairs, 32, 32), "cka", "cosine_distance", digits=6)


@query(f"with {_LAYERS_SQL} select layer::int as layer, cka from m")
def cka_by_layer(spark, sf_dir):
    return _layer_sides(spark, sf_dir).select("layer", "cka")


@query(f"with {_LAYERS_SQL} select layer::int as layer, cosine_distance from m")
def rsa_by_layer(spark, sf_dir):
    return _layer_sides(spark, sf_dir).select("layer", "cosine_distance")


@query(f"with {_LAYERS_SQL} select layer::int as layer, cka, cosine_distance from m")
def similarity_all_rows(spark, sf_dir):
    return _layer_sides(spark, sf_dir)


@query(f"with {_LAYERS_SQL} select layer::int as layer, round(sum(kx * kx), 3) as norm from k group by 1")
def centered_gram_norm(spark, sf_dir):
    """Sums over the cells of the centred Gram matrices, whose number is the square of a layer's probes, tile by tile."""
    return _rounded(gram.centered_norm(_probes(spark, sf_dir), "layer"), "norm", digits=3)


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("layer"), F.col("vec_id").alias("sample_id"), F.slice("embedding", 1, 32).alias("vec"))


@query("""with p as (select label::int as layer, vec_id as i, (embedding::double[])[1:32] as x from embeddings),
    s as (select a.layer, list_cosine_similarity(a.x, b.x) as s from p a join p b on a.layer = b.layer and a.i < b.i)
    select layer, count(*)::bigint as n_pairs, round(sum(s), 6) as total, round(sum(s * s), 6) as squares, round(min(s), 6) as least, round(max(s), 6) as most from s group by 1""")
def gram_triangle(spark, sf_dir):
    """The pairs i < j of a layer's samples, by their cosine similarity."""
    return _rounded(gram.triangle_sums(_probes(spark, sf_dir), "layer"), "total", "squares", "least", "most", digits=6)


@query("""with p as (select label::int as layer, vec_id as i, (embedding::double[])[1:32] as x from embeddings),
    s as (select a.layer, a.i, b.i as j, list_cosine_similarity(a.x, b.x) as s from p a join p b on a.layer = b.layer and a.i < b.i)
    select layer, i, j, round(s, 6) as s from s qualify row_number() over (partition by layer order by round(s, 6) desc, i, j) = 1""")
def closest_pair(spark, sf_dir):
    """The two most similar samples of each layer, out of all cells above the diagonal."""
    return gram.closest(_probes(spark, sf_dir), "layer")


@query("""with p as (select label::int as layer, vec_id as i, (embedding::double[])[1:32] as x from embeddings),
    g as (select layer, a.i, b.i as j, list_inner_product(a.x, b.x) as g from p a join p b using (layer)),
    k as (select layer, i, g - avg(g) over (partition by layer, i) - avg(g) over (partition by layer, j) + avg(g) over (partition by layer) as k from g)
    select layer, i as sample_id, round(sum(abs(k)), 6) as row_total from k group by 1, 2""")
def centered_gram_rows(spark, sf_dir):
    """The cells of each row of the doubly centred matrix."""
    cells = gram.centered_gram(_probes(spark, sf_dir), "layer")
    return _rounded(cells.groupBy("layer", F.col("i").alias("sample_id")).agg(F.sum(F.abs("k")).alias("row_total")), "row_total", digits=6)


@query(f"with {_LAYERS_SQL} select layer::int as layer, cka, cosine_distance from m")
def similarity_by_tiles(spark, sf_dir):
    """Both metrics from the cells of both sides' matrices, tile by tile."""
    side = lambda start: F.slice("embedding", start, 32)
    pairs = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("layer"), F.col("vec_id").alias("sample_id"), side(1).alias("x"), side(33).alias("y"))
    return _rounded(gram.cka_by_tiles(pairs, "layer").join(gram.rsa_by_tiles(pairs, "layer"), "layer"), "cka", "cosine_distance", digits=6)


@query("""with v as (select label, embedding::double[] as e, row_number() over (partition by label order by vec_id) as i from embeddings),
    a as (select i as source_layer, least(round_even(i * 8 / 10.0, 0), 7)::int as target_layer from range(10) t(i)),
    p as (select source_layer, target_layer, s.i, s.e[1:32] as x, t.e[33:64] as y from a join v s on s.label = source_layer join v t on t.label = target_layer and t.i = s.i), """ + _PAIRS_SQL.format(k="source_layer, target_layer") + """
    select source_layer::int as source_layer, target_layer, 'ffn' as stream, cka, cosine_distance from m""")
def aligned_layers_compared(spark, sf_dir):
    """Ten source layers against the eight aligned ones, by sample."""
    x, y = activations(spark, sf_dir, 1, 32), activations(spark, sf_dir, 33, 32).where("layer < 8")
    return _rounded(layers.compare_layers(x, y, layers.align_layers(spark, 10, 8)), "cka", "cosine_distance", digits=6)


@query("""with v as (select label, embedding::double[] as e, row_number() over (partition by label order by vec_id) as i from embeddings),
    a as (select i as source_layer, least(round_even(i * 8 / 10.0, 0), 7)::int as target_layer from range(10) t(i)),
    c as (select * from (values ('first', 1), ('last', 33)) t(condition, start)),
    p as (select condition, source_layer, target_layer, s.i, s.e[start:start + 31] as x, t.e[17:48] as y from c, a join v s on s.label = source_layer join v t on t.label = target_layer and t.i = s.i), """ + _PAIRS_SQL.format(k="condition, source_layer, target_layer") + """
    select condition, 'probes' as input_set, source_layer::int as source_layer, target_layer, 'ffn' as stream, cka, cosine_distance from m""")
def cached_conditions(spark, sf_dir):
    """Two conditions' caches of ten layers against a teacher's cache of eight, bucket by bucket."""
    folder, alignment = shared.new_folder(spark, "caches"), layers.align_layers(spark, 10, 8)
    named = lambda start, condition: activations(spark, sf_dir, start, 32).select(F.lit(condition).alias("condition"), F.lit("probes").alias("input_set"), "layer", "stream", "sample_id", "vec")
    name = folder.rsplit("-", 1)[-1]
    students = caches.write_cache(named(1, "first").unionByName(named(33, "last")), f"students_{name}", f"{folder}/students", alignment)
    teachers = caches.write_cache(named(17, "teacher").where("layer < 8").drop("condition"), f"teachers_{name}", f"{folder}/teachers")
    return _rounded(caches.compare_cached(spark, students, teachers, 32, 32), "cka", "cosine_distance", digits=6)


@query("""with z as (select (select count(*) from supplier) as s, (select count(*) from nation) as t)
    select i::int as source_layer, least(round_even(i * t / s::double, 0), t - 1)::int as target_layer from z, range((select s from z)) r(i)""")
def align_layers(spark, sf_dir):
    """As many source layers as suppliers onto as many target layers as nations."""
    return layers.align_layers(spark, *(table(spark, sf_dir, t).count() for t in ("supplier", "nation")))


@query("""with p as (select vec_id, label, embedding::double[] as e from embeddings), q as (select vec_id, label, e[1:32] as s, e[33:64] as t from p),
    z as (select vec_id, label, list_transform(s, lambda x: x / 2) as s2, list_transform(t, lambda x: x / 2) as t2, s from q),
    n as (select *, ln(list_sum(list_transform(s2, lambda x: exp(x)))) as ls, ln(list_sum(list_transform(t2, lambda x: exp(x)))) as lt, ln(list_sum(list_transform(s, lambda x: exp(x)))) as l1 from z),
    r as (select vec_id % 7 as seq, label, s[label + 1] - l1 as lp, 4 * list_sum(list_transform(range(1, 33), lambda i: exp(t2[i] - lt) * ((t2[i] - lt) - (s2[i] - ls)))) as kd from n)
    select seq::bigint as seq, round(avg(-lp) filter (where label <> 9), 6) as sft_loss, round(coalesce(sum(kd) filter (where label <> 9), 0) / greatest(count(*) filter (where label <> 9), 1), 6) as kd_loss from r group by 1""")
def distillation_losses(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pos = e.select(F.pmod("vec_id", F.lit(7)).alias("seq"), F.slice("embedding", 1, 32).alias("student"), F.slice("embedding", 33, 32).alias("teacher"), F.when(F.col("label") == 9, losses.IGNORED).otherwise(F.col("label")).alias("label"))
    return _rounded(losses.combined_loss(pos, "seq"), "sft_loss", "kd_loss", digits=6).drop("total_loss")


@query("""with p as (select (embedding::double[])[1:10] as e, label from embeddings), n as (select e, label, ln(list_sum(list_transform(e, lambda x: exp(x)))) as l from p)
    select label, round(avg(-(0.9 * (e[label + 1] - l) + 0.1 * (list_avg(e) - l))), 6) as ce from n group by 1""")
def ce_label_smoothing(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", losses.cross_entropy(F.slice("embedding", 1, 10), F.col("label"), 0.1).alias("ce"))
    return _rounded(e.groupBy("label").agg(F.avg("ce").alias("ce")), "ce", digits=6)


@query("select conv_id, turn, lead(length(text)) over (partition by conv_id order by turn)::bigint as label from conversations qualify label is not null")
def shift_labels(spark, sf_dir):
    pos = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("label"))
    return losses.shifted_labels(pos, "conv_id", "turn")


@query("with t as (select o_orderkey, (o_orderkey % 100)::bigint as batch, (o_custkey % 9 + 1)::int as n from orders), m as (select batch, max(n) as longest from t group by 1) select o_orderkey, list_sum(range(1, n + 1))::bigint as id_sum, longest::int as padded, (longest - n)::int as n_ignored from t join m using (batch)")
def pad_batch(spark, sf_dir):
    n = F.pmod("o_custkey", F.lit(9)).cast("int") + 1
    ids = F.sequence(F.lit(1), n)
    ex = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(100)).alias("batch"), ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), ids.alias("labels"))
    padded = losses.pad_batch(ex, "batch", 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, v: acc + v)
    return padded.select("o_orderkey", total("input_ids").alias("id_sum"), F.size("labels").alias("padded"), F.size(F.filter("labels", lambda v: v == losses.IGNORED)).alias("n_ignored"))


# Tools, tasks, episodes.


@query("select c_custkey, case when c_custkey % 3 = 0 then 'ToolArgumentError' end as error_type, case when c_custkey % 3 <> 0 then (50 + ('0x' || substr(md5(least(lower(c_name), lower(c_mktsegment)) || '|' || greatest(lower(c_name), lower(c_mktsegment))), 1, 32))::uhugeint % 4951)::bigint end as distance_km from customer")
def tool_calculate_distance(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    out = tools.calculate_distance(F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")), F.col("c_mktsegment"))
    return c.select("c_custkey", out.alias("o")).select("c_custkey", "o.error_type", F.get_json_object("o.result", "$.distance_km").cast("long").alias("distance_km"))


@query("select o_orderkey, 2026 - year(d) - (month(d) * 100 + day(d) > 908)::int as age_years from (select o_orderkey, o_orderdate::date as d from orders)")
def tool_calculate_age(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = tools.calculate_age(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", out.alias("o")).select("o_orderkey", F.get_json_object("o.result", "$.age_years").cast("int").alias("age_years"))


@query("select p_partkey, case when p_size > 40 then 'ToolArgumentError' end as error_type, case when p_size <= 40 then p_size * 75.0 end::double as discounted_price from part")
def tool_calculate_discount(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    out = tools.calculate_discount(F.col("p_size") * 100, F.when(F.col("p_size") > 40, F.lit(101)).otherwise(25))
    return p.select("p_partkey", out.alias("o")).select("p_partkey", "o.error_type", F.get_json_object("o.result", "$.discounted_price").cast("double").alias("discounted_price"))


_CALLED = sorted(episodes.VALID_ARGUMENTS)


@query(f"select tool, count(*)::bigint as n, 0::bigint as n_failed, 0::bigint as n_empty from (select ({_CALLED})[o_orderkey % {len(_CALLED)} + 1] as tool from orders) group by 1")
def tool_results_all(spark, sf_dir):
    """An order calls one of all tools with valid arguments, through the registries."""
    at = (F.pmod("o_orderkey", F.lit(len(_CALLED))) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at)
    calls = table(spark, sf_dir, "orders").select(pick(_CALLED).alias("tool"), pick([json.dumps(episodes.VALID_ARGUMENTS[n]) for n in _CALLED]).alias("arguments"))
    both = tools.extended_registry()
    for n, (a, d, f) in tools.corpus_registry().tools.items():
        both.register(n, a, f, d)
    done = calls.select("tool", both.call(F.col("tool"), F.col("arguments")).alias("o"))
    return done.groupBy("tool").agg(F.count("*").alias("n"), F.count("o.error_type").alias("n_failed"), F.count_if(F.col("o.result").isNull()).alias("n_empty"))


@query("select event_id, case event_id % 4 when 0 then 'final' when 1 then 'malformed' else 'call' end as kind, case when event_id % 4 > 1 then event_type end as name from events")
def parse_outputs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    call = F.concat(F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}</tool_call>"))
    text = F.when(F.col("event_id") % 4 == 0, F.lit(" done ")).when(F.col("event_id") % 4 == 1, F.lit('<tool_call>{"name": }</tool_call>')).otherwise(call)
    return e.select("event_id", parse_output(text).alias("p")).select("event_id", "p.kind", "p.name")


@query("select event_id::varchar as task_id, event_type in ('click', 'view') and event_id % 3 <> 0 and not (event_type = 'click' and event_id % 3 = 1) as success from events")
def bfcl_check(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    blank = F.concat(F.lit('{"k": '), k, F.lit(', "unit": ""}'))  # "" says that a parameter may be left out, it is no value
    given = F.when(F.col("event_id") % 3 == 0, '{"other": 1}').when((F.col("event_id") % 3 == 1) & (F.col("event_type") == "click"), blank).otherwise(F.col("props"))
    output = F.concat(F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": '), given, F.lit("}</tool_call>"))
    truth = F.concat(F.lit('{"click": {"k": ['), k, F.lit(', "x"], "unit": ["", "s"]}, "view": {"k": [-1, '), k, F.lit("]}}"))
    return checker.score_calls(e.select(F.col("event_id").cast("string").alias("id"), output.alias("output"), truth.alias("truth")), F.lit("base"), F.lit("simple")).select("task_id", "success")


@query("with a as (select event_id, value as a, case when event_id % 2 = 0 then value + 5e-7 else value + 1 end as e from events) select event_id, abs(a - e) <= 1e-6 * greatest(1.0, abs(e)) as matches from a")
def values_match(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    near = F.when(F.col("event_id") % 2 == 0, F.col("value") + 5e-7).otherwise(F.col("value") + 1)
    return e.select("event_id", values.values_match_col(F.format_string("%.12f", "value"), F.format_string("%.12f", near)).alias("matches"))


@query("select n_nationkey::int as seed, r_name as condition from nation join region on n_regionkey = r_regionkey")
def parse_jobs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    spec = n.groupBy("r_name").agg(F.concat_ws(", ", F.collect_list(F.concat_ws(":", "n_nationkey", "r_name")), F.lit("")).alias("spec"))
    return jobs.parse_jobs(spec, ["seed", "condition"])


# Files.


@query("select event_id, event_type, user_id, round(value, 9) as value, props, event_type || ' \"[,' || chr(92) || '{' || event_id as note from events")
def json_array_files(spark, sf_dir):
    """Arrays that tasks write, read back by ranges that cut elements and strings anywhere."""
    note = F.concat("event_type", F.lit(' "[,\\{'), F.col("event_id").cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", "props", note.alias("note"))
    folder = shared.new_folder(spark, "arrays")
    json_arrays.write_json_arrays(e.repartition(3, "event_id"), folder)
    back = json_arrays.read_json_arrays(spark, f"{folder}/*.json", "event_id bigint, event_type string, user_id bigint, value double, props string, note string", 262_147)
    return _rounded(back.drop("file", "at"), "value")


@query("select event_id::varchar as id, event_type || chr(10) || 'k' as user_message, case when event_id % 4 = 1 then 'last' else 'first' end || event_id as truth from events where event_id % 3 <> 0 and event_id % 5 <> 0")
def examples_from_files(spark, sf_dir):
    """Questions and answers as two files of lines: some have no answer, some two truths, some a later answer that wins."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("id"), "event_type")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turns = F.array(F.array(message("system", F.lit("s")), message("user", F.col("event_type"))), F.array(message("user", F.lit("k"))))
    function = F.array(F.struct(F.col("event_type").alias("name"), F.lit("d").alias("description"), F.struct(F.lit(1).alias("x")).alias("parameters")))
    folder = shared.new_folder(spark, "examples")
    writers.write_jsonl(e.select("id", turns.alias("question"), function.alias("function")), f"{folder}/questions")
    truth = lambda name: F.concat(F.lit(name), "id")
    first = e.where("event_id % 3 <> 0").select("id", F.when(F.col("event_id") % 5 == 0, F.array(truth("a"), truth("b"))).otherwise(F.array(truth("first"))).alias("ground_truth"))
    again = e.where("event_id % 3 <> 0 and event_id % 5 <> 0 and event_id % 4 = 1").select("id", F.array(truth("last")).alias("ground_truth"))
    writers.write_jsonl(first, f"{folder}/answers/a")
    writers.write_jsonl(again, f"{folder}/answers/b")
    return readers.read_examples(spark, f"{folder}/questions", f"{folder}/answers/*").select("id", "user_message", "truth")


@query("select event_id, case when event_id % 7 = 0 then null else event_type end as event_type, event_id % 7 = 0 as broken from events")
def lines_with_quarantine(spark, sf_dir):
    """Lines of which some are cut off: rows and broken lines of one scan."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_json(F.struct(F.col("event_id").cast("int").alias("step"), F.lit(1).alias("epoch"), F.col("value").alias("sft_loss"), F.col("event_type").alias("note"))).alias("line"))
    folder = shared.new_folder(spark, "lines")
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("substring(line, 1, locate(',', line))")).otherwise(F.col("line"))
    e.select(cut.alias("value")).write.text(f"{folder}/in")
    rows, broken = readers.read_lines(spark, f"{folder}/in", LOSS_LOG + ", note string", f"{folder}/read")
    number = F.regexp_extract("broken_line", r'"step":(\d+)', 1).cast("long")
    good = rows.select(F.col("step").cast("long").alias("event_id"), F.col("note").alias("event_type"), F.lit(False).alias("broken"))
    return good.unionByName(broken.select(number.alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.lit(True).alias("broken")))


@query(f"with {STEPS_SQL.strip()} select condition, task_set, chain_length::int as chain_length, {_RATES} from tasks group by 1, 2, 3")
def results_csv_round_trip(spark, sf_dir):
    """Rates of result rows that were written as CSV, nested steps as JSON, and read again."""
    folder = shared.new_folder(spark, "results")
    writers.write_results_csv(metrics.with_task_set(result_rows(spark, sf_dir)), folder)
    return _rounded(metrics.summarize(readers.read_results_csv(spark, folder), "condition", "task_set", "chain_length"), *_RATE_NAMES)


@query(f"with {STEPS_SQL.strip()}, r as (select 'rows' as part, condition, count(*)::bigint as n from tasks group by all) select * from r union all select 'summary', condition, count(distinct chain_length)::bigint from tasks group by all")
def run_outputs(spark, sf_dir):
    """A run whose first attempt fails between two tables, whose second is committed and whose third changes nothing."""
    rows = result_rows(spark, sf_dir).select("condition", "task_id", "chain_length", "success", "steps", "injected_error_at_step")
    summary = metrics.summarize(rows, "condition", "chain_length")
    failing = summary.withColumn("n_tasks", F.raise_error(F.lit("the worker was lost")).cast("bigint"))
    folder = shared.new_folder(spark, "run")
    with contextlib.suppress(Exception):
        commits.commit(spark, folder, "r1", 0, {"rows": rows, "summary": failing})
    if commits.committed(spark, folder, "r1"):
        raise AssertionError("half a run was committed")
    for _ in range(2):
        commits.commit(spark, folder, "r1", 0, {"rows": rows, "summary": summary})
    parts = [commits.read_part(spark, folder, "r1", p).groupBy("condition").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "condition", "n") for p in ("rows", "summary")]
    return parts[0].unionByName(parts[1])


@query("""select c_custkey, 'runs/v2-seed' || c_nationkey || '/results/stages/sweep_' || c_mktsegment || case when c_custkey % 2 = 0 then '_n' || c_custkey else '' end || '.json' as result,
    'runs/v2-seed' || c_nationkey || '/results/training_logs/sweep_' || c_mktsegment || '.jsonl' as log, 'results/training_logs/' || c_mktsegment || case when c_custkey % 2 = 0 then '-n' || c_custkey else '' end || '.jsonl' as own_log from customer""")
def job_paths(spark, sf_dir):
    """Where the results and logs of jobs lie; half of the jobs have a suffix."""
    suffix = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("n"), F.col("c_custkey").cast("string")))
    seed, name = F.col("c_nationkey"), F.col("c_mktsegment")
    paths = jobs.stage_file(seed, F.lit("sweep"), name, suffix).alias("result"), jobs.log_file(seed, F.lit("sweep"), name).alias("log"), jobs.local_log(name, suffix).alias("own_log")
    return table(spark, sf_dir, "customer").select("c_custkey", *paths)


@query(f"with {STEPS_SQL.strip()} select condition, printf('%d tasks, success %.3f', count(*)::bigint, sum(success::int)::double / greatest(count(*), 1)) as text from tasks group by 1")
def described_results(spark, sf_dir):
    return metrics.described(metrics.describe(result_rows(spark, sf_dir), "condition")).select("condition", "text")


# Event time (an addition).


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*)::bigint as n, round(sum(value), 6) as total from events group by 1, 2")
def tumbling_windows(spark, sf_dir):
    return _rounded(events.windowed(table(spark, sf_dir, "events"), "1 hour"), "total", digits=6)


@query("with w as (select time_bucket(interval '30 minutes', ts) - to_minutes(k * 30) as window_start, event_type, value from events, range(2) t(k)) select window_start, event_type, count(*)::bigint as n, round(sum(value), 6) as total from w group by 1, 2")
def sliding_windows(spark, sf_dir):
    return _rounded(events.windowed(table(spark, sf_dir, "events"), "1 hour", "30 minutes"), "total", digits=6)


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '1 hour' then 0 else 1 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as k from g) select user_id, min(ts) as session_start, count(*)::bigint as n from s group by user_id, k""")
def session_windows(spark, sf_dir):
    return events.sessions(table(spark, sf_dir, "events"), "1 hour")


@query("select slug, n from (select replace(replace(lower(p_type), ' ', '_'), '-', '_') as slug, count(*)::bigint as n from part group by 1)")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(numbers.slug(F.col("p_type")).alias("slug")).agg(F.count("*").alias("n"))


# One query per tool: the tool over a table's columns, with the SQL of what it must give.


def _tool_query(name: str, source: str, key: str, build, field: str, kind: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, source)
        return t.select(key, build(t).alias("o")).select(key, "o.error_type", F.get_json_object("o.result", f"$.{field}").cast(kind).alias(field))

    run.__name__ = f"tool_{name}"
    run.__doc__ = f"{name} over {source}."
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = sql


_pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))

_tool_query("get_weather", "nation", "n_nationkey", lambda t: tools.get_weather(_pick(["Paris", " TOKYO ", "Atlantis", "cairo"], F.col("n_nationkey"))), "temperature_f", "int",
            "select n_nationkey, case when n_nationkey % 4 = 2 then 'ToolExecutionError' end as error_type, ([59, 71, null, 95])[n_nationkey % 4 + 1]::int as temperature_f from nation")
_tool_query("get_current_time", "nation", "n_nationkey", lambda t: tools.get_current_time(_pick(["utc", "JST", "mars"], F.col("n_nationkey"))), "current_time", "string",
            "select n_nationkey, case when n_nationkey % 3 = 2 then 'ToolExecutionError' end as error_type, (['2026-09-08T12:00:00Z', '2026-09-08T21:00:00+09:00', null])[n_nationkey % 3 + 1] as current_time from nation")
_tool_query("get_population", "nation", "n_nationkey", lambda t: tools.get_population(F.col("n_name")), "population_millions", "int",
            "select n_nationkey, case when p is null then 'ToolExecutionError' end as error_type, p::int as population_millions from nation left join (values ('china', 1412), ('india', 1408), ('united states', 333), ('indonesia', 276), ('brazil', 214), ('japan', 125), ('egypt', 109), ('germany', 84), ('france', 68), ('united kingdom', 67)) v(c, p) on c = lower(trim(n_name))")
_tool_query("get_capital", "nation", "n_nationkey", lambda t: tools.get_capital(F.col("n_name")), "capital", "string",
            "select n_nationkey, case when p is null then 'ToolExecutionError' end as error_type, p as capital from nation left join (values ('france', 'paris'), ('japan', 'tokyo'), ('egypt', 'cairo'), ('germany', 'berlin'), ('united kingdom', 'london'), ('india', 'new delhi'), ('brazil', 'brasilia'), ('china', 'beijing'), ('united states', 'washington'), ('indonesia', 'jakarta')) v(c, p) on c = lower(trim(n_name))")
_tool_query("get_elevation", "nation", "n_nationkey", lambda t: tools.get_elevation(_pick(["Fuji", "Everest", "nowhere"], F.col("n_nationkey"))), "elevation_m", "int",
            "select n_nationkey, case when n_nationkey % 3 = 2 then 'ToolExecutionError' end as error_type, ([3776, 8849, null])[n_nationkey % 3 + 1]::int as elevation_m from nation")
_tool_query("search_knowledge_base", "nation", "n_nationkey", lambda t: tools.search_knowledge_base(_pick(["lora", "", "zebra", "MODEL"], F.col("n_nationkey"))), "query", "string",
            "select n_nationkey, (array[null, 'ToolArgumentError', 'ToolExecutionError', null])[n_nationkey % 4 + 1] as error_type, (['lora', null, null, 'MODEL'])[n_nationkey % 4 + 1] as query from nation")
_tool_query("calculator", "part", "p_partkey", lambda t: tools.calculator(F.concat(F.col("p_size").cast("string"), F.lit(" * 4 - "), F.when(F.col("p_size") % 5 == 0, "x").otherwise("3"))), "result", "long",
            "select p_partkey, case when p_size % 5 = 0 then 'ToolArgumentError' end as error_type, case when p_size % 5 <> 0 then p_size * 4 - 3 end::bigint as result from part")
_tool_query("convert_temperature", "part", "p_partkey", lambda t: tools.convert_temperature(F.col("p_size") * 9 + 32, F.lit("F"), F.when(F.col("p_size") % 4 == 0, "x").otherwise("Celsius")), "converted_value", "double",
            "select p_partkey, case when p_size % 4 = 0 then 'ToolArgumentError' end as error_type, case when p_size % 4 <> 0 then p_size * 5.0 end::double as converted_value from part")
_tool_query("convert_length", "part", "p_partkey", lambda t: tools.convert_length(F.when(F.col("p_size") % 6 == 0, -F.col("p_size")).otherwise(F.col("p_size")), F.lit("km"), F.lit("Metres")), "converted_value", "double",
            "select p_partkey, case when p_size % 6 = 0 then 'ToolArgumentError' end as error_type, case when p_size % 6 <> 0 then p_size * 1000.0 end::double as converted_value from part")
_tool_query("compare_numbers", "orders", "o_orderkey", lambda t: tools.compare_numbers(F.when(F.col("o_orderkey") % 9 == 0, float("nan")).otherwise(F.col("o_orderkey").cast("double")), F.col("o_custkey")), "larger", "string",
            "select o_orderkey, case when o_orderkey % 9 = 0 then 'ToolArgumentError' end as error_type, case when o_orderkey % 9 = 0 then null when o_orderkey = o_custkey then 'equal' when o_orderkey > o_custkey then 'a' else 'b' end as larger from orders")
_tool_query("average_numbers", "orders", "o_orderkey", lambda t: tools.average_numbers(F.col("o_orderkey"), F.col("o_custkey")), "average", "double",
            "select o_orderkey, null::varchar as error_type, (o_orderkey + o_custkey) / 2.0::double as average from orders")
_tool_query("round_number", "part", "p_partkey", lambda t: tools.round_number(F.col("p_size") + F.lit(0.5), F.when(F.col("p_size") % 7 == 0, 11).otherwise(0)), "rounded", "double",
            "select p_partkey, case when p_size % 7 = 0 then 'ToolArgumentError' end as error_type, case when p_size % 7 <> 0 then round_even(p_size + 0.5, 0) end::double as rounded from part")
_tool_query("convert_currency", "part", "p_partkey", lambda t: tools.convert_currency(F.col("p_size"), F.when(F.col("p_size") % 8 == 0, " ").otherwise("US dollars"), F.lit("yen")), "converted_amount", "double",
            "select p_partkey, case when p_size % 8 = 0 then 'ToolArgumentError' end as error_type, case when p_size % 8 <> 0 then p_size * 147.0 end::double as converted_amount from part")
_tool_query("get_stock_price", "part", "p_partkey", lambda t: tools.get_stock_price(_pick(["AAPL", "msft", "a1"], F.col("p_partkey"))), "price", "double",
            "select p_partkey, case when p_partkey % 3 = 2 then 'ToolArgumentError' end as error_type, ([189.5, 415.2, null])[p_partkey % 3 + 1]::double as price from part")
_tool_query("calculate_bmi", "part", "p_partkey", lambda t: tools.calculate_bmi(F.when(F.col("p_size") % 10 == 0, 0).otherwise(2), F.col("p_size") * 4), "bmi", "double",
            "select p_partkey, case when p_size % 10 = 0 then 'ToolArgumentError' end as error_type, case when p_size % 10 <> 0 then p_size * 1.0 end::double as bmi from part")
_tool_query("calculate_tip", "part", "p_partkey", lambda t: tools.calculate_tip(F.col("p_size") * 10, F.when(F.col("p_size") % 11 == 0, -1).otherwise(20)), "total_amount", "double",
            "select p_partkey, case when p_size % 11 = 0 then 'ToolArgumentError' end as error_type, case when p_size % 11 <> 0 then p_size * 12.0 end::double as total_amount from part")


@query("""with p as (select p_partkey, p_size, ('0x' || md5('1|' || p_size))::uhugeint % 10000000 as h from part)
    select p_partkey, p_size, case when p_size <= 1 then 'ToolArgumentError' end as error_type, case when p_size > 1 then least(floor(1 + h / 10000000.0 * p_size), p_size) end::bigint as value from p""")
def tool_generate_random_number(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    out = tools.generate_random_number(F.lit(1).cast("long"), F.col("p_size").cast("long"))
    return p.select("p_partkey", "p_size", out.alias("o")).select("p_partkey", "p_size", "o.error_type", F.get_json_object("o.result", "$.value").cast("long").alias("value"))


@query("with a as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as place from orders), b as (select o_custkey, o_orderkey as k, row_number() over (order by o_orderkey) - 1 as place from orders) select place::bigint as place, o_orderkey, o_custkey from a join b using (place)")
def zip_strict(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    zipped = joins.zip_strict(o.select("o_orderkey"), o.select("o_orderkey", "o_custkey"), "o_orderkey", "o_orderkey")
    return zipped.select("place", F.col("a.o_orderkey").alias("o_orderkey"), F.col("b.o_custkey").alias("o_custkey"))


@query("select label::int as layer, count(*)::bigint as n from embeddings where label in (1, 3, 5) group by 1")
def layer_subset(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("layer"), "vec_id")
    return joins.layer_subset(vectors, spark.sql("select * from values (1), (3), (5) as t(layer)")).groupBy("layer").agg(F.count("*").alias("n"))


@query("select (user_id % 16)::bigint as batch, count(*)::bigint as n, max(length(props))::bigint as longest, sum(length(props))::bigint as total, (count(*) filter (where length(props) >= 9))::bigint as hit_budget from events group by 1")
def batch_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(16)).alias("batch"), F.length("props").cast("long").alias("n_tokens"), F.lit(9).alias("budget"))
    return joins.batch_stats(e)


@query(f"with {STEPS_SQL.strip()}, r as (select case when chain_length <= 3 then 'short' else 'long' end as level, case when task_set = 'seen_tools' then 'treated' else 'control' end as arm, avg(success::int::double) as rate from tasks group by 1, 2) select round((select rate from r where level = 'short' and arm = 'treated') - (select rate from r where level = 'short' and arm = 'control'), 9) as gain_low, round((select rate from r where level = 'long' and arm = 'treated') - (select rate from r where level = 'long' and arm = 'control'), 9) as gain_high")
def interaction_contrast(spark, sf_dir):
    rows = metrics.with_task_set(result_rows(spark, sf_dir))
    cells = rows.groupBy(F.when(F.col("chain_length") <= 3, "short").otherwise("long").alias("level"), F.when(F.col("task_set") == "seen_tools", "treated").otherwise("control").alias("arm")).agg(metrics.chain_success_rate().alias("rate"))
    return _rounded(joins.interaction(cells, "short", "long").drop("interaction"), "gain_low", "gain_high")


# Reports and runs.


@query("select o_custkey % 16 as bucket, avg(o_orderkey) filter (where o_orderpriority = '1-URGENT') as \"1-URGENT\", avg(o_orderkey) filter (where o_orderpriority = '5-LOW') as \"5-LOW\" from orders group by 1")
def pivot_of_means(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(16)).alias("bucket"), "o_orderpriority", "o_orderkey")
    return reports.pivoted(o, "bucket", "o_orderpriority", ["1-URGENT", "5-LOW"], "o_orderkey")


@query("select t.ord, t.event_type, round(avg(value), 9) as value from (values (0, 'view'), (1, 'never_seen'), (2, 'click')) t(ord, event_type) left join events using (event_type) group by 1, 2")
def means_in_order(spark, sf_dir):
    return _rounded(reports.reindexed_means(table(spark, sf_dir, "events"), "event_type", ["view", "never_seen", "click"], "value"), "value")


@query("select label, count(*)::bigint as n, sum((embedding[1] > embedding[2])::int)::bigint as n_closer, round(avg(abs(embedding[1]::double - embedding[2]::double)), 9) as mean_gap, round(max(abs(embedding[1]::double - embedding[2]::double)), 9) as max_gap from embeddings group by 1")
def closer_count(spark, sf_dir):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return _rounded(reports.closer(table(spark, sf_dir, "embeddings").select("label", at(0).alias("a"), at(1).alias("b")), "a", "b", "label"), "mean_gap", "max_gap")


@query("select user_id, event_id as step, round(value, 9) as loss, round(value - lag(value) over (partition by user_id order by event_id), 9) as change from events where event_id % 3 = 0")
def loss_curve(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return _rounded(reports.loss_curve(log, "user_id", "loss", 3), "loss", "change")


@query("select event_id, event_type from events where event_type = 'click' order by event_id limit 5")
def capped_samples(spark, sf_dir):
    return reports.first_rows(table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "event_type"), "event_id")


@query("select l_orderkey, l_linenumber, count(*)::bigint as n from lineitem group by 1, 2 having count(*) > 1")
def repeated_keys(spark, sf_dir):
    return reports.repeated_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("select 'm' as condition, round(avg((event_id % 2 = 0)::int), 9) as accuracy, (count(*) filter (where event_id % 2 <> 0))::bigint as n_malformed from events")
def single_turn_run(spark, sf_dir):
    """A model that calls the function of its prompt on even ids and writes broken JSON on odd ones."""
    function = F.array(F.struct(F.lit("f").alias("name"), F.lit("a function").alias("description"), F.lit("{}").alias("parameters")))
    examples = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.lit('{"f": {"k": [1]}}').alias("truth"), function.alias("function"), F.col("event_id").cast("string").alias("user_message"))
    return _rounded(runs.summarize_calls(runs.run_calls(examples, episodes.even_caller, "m", "simple")), "accuracy")
