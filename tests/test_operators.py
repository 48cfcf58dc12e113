import json
import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepwell.functions import losses, stats, values
from stepwell.functions.numbers import md5_mod, py_round
from stepwell.operators import layers, metrics, sampling
from stepwell.plans import jobs
from stepwell.plans.queries import QUERIES
from stepwell.schemas import RESULT
from stepwell.sources import readers, writers


def rows_of(spark, rows):
    base = {"condition": "a", "task_set": None, "chain_length": 1, "task_id": "t", "success": True, "num_steps_attempted": 0, "injected_error_at_step": None, "failure_step_index": None, "failure_error_type": None, "steps": [], "transcript": None}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], RESULT)


def step(i, ok, recovered=False, match=None, error=None):
    return (i, "x", ok, recovered, None, error, match)


def test_rates_over_nothing_are_null(spark):
    got = metrics.summarize(rows_of(spark, [])).first()
    assert got["n_tasks"] == 0 and got["full_chain_success_rate"] is None and got["per_step_success_rate"] is None
    one = metrics.summarize(rows_of(spark, [{}])).first()
    assert one["full_chain_success_rate"] == 1.0 and one["recovery_rate"] is None and one["argument_accuracy"] is None
    assert metrics.describe(rows_of(spark, [])).first()["success_rate"] == 0


def test_rates(spark):
    rows = rows_of(spark, [
        {"steps": [step(0, True), step(1, True, True, True)], "injected_error_at_step": 1},
        {"success": False, "steps": [step(0, False, match=False, error="WrongToolError")], "failure_error_type": "WrongToolError", "injected_error_at_step": 3},
        {"success": False, "steps": [step(0, False, error="NewError")], "failure_error_type": "NewError", "injected_error_at_step": 0},
    ])
    got = metrics.summarize(rows).first()
    assert got["per_step_success_rate"] == 0.5 and got["clean_step_success_rate"] == 0.25 and got["recovery_rate"] == 0.5 and got["argument_accuracy"] == 0.5
    summary = metrics.summary_by_condition_and_chain_length(rows).first()
    assert summary["task_set"] == "unseen_tools" and summary["error_category_breakdown"] == {"protocol": 1, "unknown": 1}


def test_csv_and_json_round_trip(spark, tmp_path):
    rows = rows_of(spark, [{"steps": [step(0, True, match=True), step(1, False, error='Bad "x", y')], "failure_error_type": "E", "success": False, "task_set": "s"}])
    writers.write_results_csv(rows, str(tmp_path / "c"))
    back = readers.read_results_csv(spark, str(tmp_path / "c")).first()
    assert back["steps"] == rows.first()["steps"] and back["success"] is False and back["failure_step_index"] is None
    writers.write_jsonl(rows, str(tmp_path / "j"))
    assert readers.read_results(spark, str(tmp_path / "j")).collect() == rows.collect()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_jsonl(rows, str(tmp_path / "j"))
    assert writers.ablation_path("a/train.jsonl", 2) == "a/train_ntools2.jsonl"


def test_split_properties(spark):
    df = spark.range(100).withColumn("tool", F.when(F.col("id") < 97, "a").otherwise("b"))
    s = sampling.balance_and_split(df, "tool", "id", 10, 0.8, 1)
    counts = {(r["tool"], r["split"]): r["count"] for r in s.groupBy("tool", "split").count().collect()}
    assert counts == {("a", "train"): 8, ("a", "test"): 2, ("b", "train"): 2, ("b", "test"): 1}
    assert sorted(s.collect()) == sorted(sampling.balance_and_split(df.repartition(7), "tool", "id", 10, 0.8, 1).collect())
    small, large = (set(sampling.subsample(df, "tool", "id", k, 3).collect()) for k in (3, 9))
    assert small < large


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, ord int, v string")
    assert sorted(r["v"] for r in sampling.last_wins(df, "id", F.col("ord")).collect()) == ["b", "c"]
    assert sorted(r["v"] for r in sampling.first_wins(df, "id", F.col("ord")).collect()) == ["a", "c"]


def test_helpers_leave_columns_of_any_name_alone(spark):
    names = ["_rn", "row", "nth", "part", "own", "start", "n", "by", "_found", "found", "k", "k0", "at", "first", "_first", "failed"]
    df = spark.createDataFrame([(1, 1, *range(len(names))), (1, 2, *range(len(names)))], ", ".join(f"{c} int" for c in ["key", "ord", *names]))
    assert [tuple(r) for r in sampling.last_wins(df, "key", F.col("ord")).collect()] == [(1, 2, *range(len(names)))]
    assert [tuple(r)[:-1] for r in sampling.global_place(df, "ord").orderBy("place").collect()] == [tuple(r) for r in df.orderBy("ord").collect()]
    cut = metrics.up_to_first_failure(df, ["key"], "ord", F.col("ord") == 1)
    assert [tuple(r) for r in cut.collect()] == [(1, 1, *range(len(names)))] and cut.columns == df.columns
    from stepwell.operators import joins

    found = joins.require(df, spark.createDataFrame([(1, "x")], "key int, size string"), "key", "key")
    assert found.columns == [*df.columns, "size"] and found.count() == 2


def test_places_hold_where_ranges_come_from_samples(spark, tmp_path, request):
    from stepwell.operators import joins

    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    n = 60_000  # more rows than are sampled for the ranges
    spark.range(n).select(F.shuffle(F.sequence(F.lit(0), F.lit(2)))[0].alias("x"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("k")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as in a table too large to be joined into one partition
    assert sampling.global_place(rows, "k").where("place <> k").count() == 0
    zipped = joins.zip_strict(rows.select("k"), rows.select("k", "x"), "k", "k")
    assert zipped.where("a.k = b.k and a.k = place").count() == n
    batches = sampling.epoch_batches(rows.select("k"), "k", 42, 3, 64)
    assert batches.groupBy("batch").count().where("count <> 64").count() == 0 and batches.count() == n // 64 * 64


def test_the_stats_parse_texts_once(spark):
    assert QUERIES["prepare_stats_rows"](spark, "/root/testdata/sf0.001").inputFiles() == []  # counted and written; no text is read again


def test_python_rounding_and_hash(spark):
    df = spark.createDataFrame([(2.675,), (0.125,), (-1.005,)], "v double")
    assert [r[0] for r in df.select(py_round(F.col("v"), 2)).collect()] == [round(x, 2) for x in (2.675, 0.125, -1.005)]
    import hashlib

    got = spark.createDataFrame([("abc",)], "t string").select(md5_mod(F.col("t"), 4951)).first()[0]
    assert got == int(hashlib.md5(b"abc").hexdigest(), 16) % 4951


def test_mcnemar_tail(spark):
    pairs = [(a, b) for a in range(0, 41, 4) for b in range(0, 41, 5)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", stats.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()
    for a, b, p in got:
        n, k = a + b, min(a, b)
        assert p == pytest.approx(1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n))


def test_mcnemar_column(spark):
    got = spark.createDataFrame([(3, 12), (0, 0), (5, 5)], "a int, b int").select(stats.mcnemar(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == pytest.approx([0.03515625, 1.0, 1.0])


def test_mcnemar_of_many_pairs(spark):
    pairs = [(540, 561), (1000, 1000), (1000, 1100), (3000, 3200), (0, 1100), (700, 0)]
    got = spark.createDataFrame(pairs, "a int, b int").select(stats.mcnemar(F.col("a"), F.col("b"))).collect()
    want = [min(1.0, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b)) if a * b else 2.0 ** (1 - a - b) for a, b in pairs]
    assert [r[0] for r in got] == pytest.approx(want, rel=1e-9, abs=0)


def test_similarity_reads_every_row(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("label", "embedding").toPandas()
    got = {r["layer"]: r for r in QUERIES["similarity_all_rows"](spark, "/root/testdata/sf0.01").collect()}
    assert rows.groupby("label").size().max() > 0 and set(got) == set(rows["label"])
    for label, own in rows.groupby("label"):
        e = np.array(own["embedding"].tolist(), np.float64)
        assert got[label]["cka"] == pytest.approx(layers.cka(e[:, :32], e[:, 32:64]), abs=2e-6)
        assert got[label]["cosine_distance"] == pytest.approx(layers.rsa(e[:, :32], e[:, 32:64]), abs=2e-6)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = np.hstack([x[:, :2] * 2, rng.normal(size=(300, 2))])  # more rows than 30
    y[31:] += 5
    pairs = spark.createDataFrame([(0, a.tolist(), b.tolist()) for a, b in zip(x, y)], "layer int, x array<double>, y array<double>")
    found = layers.similarity_of_all(pairs, 3, 4).first()
    assert (found["cka"], found["cosine_distance"]) == (pytest.approx(layers.cka(x, y)), pytest.approx(layers.rsa(x, y)))
    assert found["cka"] != pytest.approx(layers.cka(x[:30], y[:30]), abs=1e-3)


def test_interval_of_ten_thousand_draws(spark, monkeypatch):
    seen = []
    own = stats.template_bootstrap
    monkeypatch.setattr(stats, "template_bootstrap", lambda *args: seen.append(own(*args)) or seen[-1])
    got = QUERIES["bootstrap_interval"](spark, "/root/testdata/sf0.001").first()
    drawn = np.array([r["difference"] for r in seen[0].collect()])
    assert len(drawn) == 10_000
    assert (got["low"], got["high"]) == tuple(pytest.approx(np.percentile(drawn, x), abs=2e-6) for x in (2.5, 97.5))


def test_perplexity_of_cut_texts(spark):
    rows = [("g", "a", k, 1.0 + k) for k in range(5)] + [("g", "b", 0, 9.0), ("g", "c", 0, 9.0), ("g", "c", 1, 3.0), ("g", None, 1, 99.0)]
    df = spark.createDataFrame(rows, "g string, text_id string, place int, nll double")
    got = metrics.perplexity_of_tokens(df, "g", max_length=3).first()
    assert (got["n_tokens"], got["n_texts"]) == (3, 2) and got["perplexity"] == pytest.approx(math.exp((2 + 3 + 3) / 3))
    uniform = spark.createDataFrame([("a", k, math.log(50)) for k in range(700)], "text_id string, place int, nll double")
    assert metrics.perplexity_of_tokens(uniform).first()["perplexity"] == pytest.approx(50)
    with pytest.raises(Exception, match="no text has two tokens"):
        metrics.perplexity_of_tokens(df.where("text_id = 'b'"), "g").collect()


def test_description_of_some_task_sets(spark):
    rows = rows_of(spark, [{"task_set": "s"}, {"task_set": "t", "success": False}, {"task_set": None}])
    assert metrics.describe(rows, task_sets=("s", "t")).first()["n_rows"] == 2
    assert metrics.describe(rows, task_sets=("unseen_tools",)).first()["n_rows"] == 1
    assert metrics.describe(rows, task_sets=("nothing",)).first()["success_rate"] == 0


def test_layer_metrics():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 10)), rng.normal(size=(20, 6))
    assert layers.cka(x, x) == pytest.approx(1) and layers.cka(x, 3 * x @ np.linalg.qr(rng.normal(size=(10, 10)))[0]) == pytest.approx(1)
    assert layers.cka(x, np.ones((20, 3))) == 0 and layers.rsa(x, x) == pytest.approx(0, abs=1e-9)
    assert layers.cka(x, y) == pytest.approx(layers.cka(y, x))
    with pytest.raises(ValueError):
        layers.cka(x, y[:5])


def test_losses(spark):
    rng = np.random.default_rng(1)
    s, t = rng.normal(size=(6, 5)), rng.normal(size=(6, 5))
    label = [0, 1, losses.IGNORED, 3, 4, 2]
    df = spark.createDataFrame([(1, a.tolist(), b.tolist(), c) for a, b, c in zip(s, t, label)], "g int, student array<double>, teacher array<double>, label int")
    soft = lambda z, T: z / T - np.log(np.exp(z / T).sum(1, keepdims=True))
    on = np.array(label) != losses.IGNORED
    kd = (np.exp(soft(t, 2)) * (soft(t, 2) - soft(s, 2))).sum(1)[on].mean() * 4
    ce = -np.mean([soft(s, 1)[i, c] for i, c in enumerate(label) if c != losses.IGNORED])
    got = losses.combined_loss(df, "g").first()
    assert got["kd_loss"] == pytest.approx(kd) and got["sft_loss"] == pytest.approx(ce) and got["total_loss"] == pytest.approx((kd + ce) / 2)
    none = losses.combined_loss(df.withColumn("label", F.lit(losses.IGNORED)), "g").first()
    assert none["sft_loss"] is None and none["kd_loss"] == 0
    assert losses.optimizer_steps(640, 8, 1, 3) == 240
    with pytest.raises(ValueError):
        losses.combined_loss(df, "g", temperature=0)


def test_values(spark):
    pairs = [("1", "1.0000001", True), ("true", "1", False), ("1", "true", False), ("true", "true", True), ('" A "', '"a"', True), ('"1"', "1", False), ("null", "null", True), ("null", '""', False), ("[1, 2]", "[1,2]", True), ('{"b": 1, "a": 2}', '{"a": 2, "b": 1}', True), ("2.5", "2.5", True), ("1000000", "1000000.5", True), ("1", "1.1", False)]
    df = spark.createDataFrame(pairs, "x string, y string, want boolean")
    for r in df.select("*", values.values_match_col(F.col("x"), F.col("y")).alias("got")).collect():
        assert r["got"] == r["want"] == values.Loose(json.loads(r["x"])).agrees_with(json.loads(r["y"])), r
    pairs = [('{"a": 1, "b": "x"}', '{"b": " X", "a": 1.0}', True), ('{"a": 1}', '{"a": 1, "b": 2}', False), ("{}", "{}", True), ('{"a": 1}', '{"b": 1}', False), ('{"a": true}', '{"a": 1}', False)]
    df = spark.createDataFrame(pairs, "x string, y string, want boolean")
    for r in df.select("*", values.arguments_match_col(F.col("x"), F.col("y")).alias("got")).collect():
        assert r["got"] == r["want"] == values.same_call_arguments(json.loads(r["x"]), json.loads(r["y"])), r


def test_accepted_calls(spark):
    truth = json.dumps({"f": {"a": [1, 2], "b": ["", "x"], "c": [[1, 2]]}})
    cases = [
        ('{"name": "f", "arguments": {"a": 2, "c": [1, 2]}}', True), ('{"name": "f", "arguments": {"a": 2, "b": "X ", "c": [1, 2.0]}}', True), ('{"name": "f", "arguments": {"a": 3, "c": [1, 2]}}', False),
        ('{"name": "f", "arguments": {"a": 1, "c": 1}}', False), ('{"name": "f", "arguments": {"a": 1, "c": [1, 2], "z": 0}}', False), ('{"name": "g", "arguments": {}}', False), ('{"name": "f", "arguments": {"c": [1, 2]}}', False),
        ('{"name": "f", "arguments": {"a": 2, "b": "", "c": [1, 2]}}', False), ('{"name": "f", "arguments": {"a": 2, "b": " ", "c": [1, 2]}}', False), ('{"name": "f", "arguments": {"a": 2, "c": [1, 2, 3]}}', False), ('{"name": "f", "arguments": {"a": [1], "c": [1, 2]}}', False),
    ]
    df = spark.createDataFrame([(c, truth, w) for c, w in cases], "c string, t string, want boolean")
    for r in df.select("*", values.call_accepted_col(F.col("c"), F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_losses_of_a_large_vocabulary(spark):
    n = 32_000
    df = spark.range(4).select(F.col("id").alias("g"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i + F.col("id"))).alias("student"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.cos(i)).alias("teacher"), F.lit(7).alias("label"))
    began = time.time()
    got = {r["g"]: r for r in losses.combined_loss(df, "g").collect()}
    assert time.time() - began < 30
    i = np.arange(1, n + 1)
    soft = lambda z: z - np.log(np.exp(z).sum())
    assert got[2]["sft_loss"] == pytest.approx(-soft(np.sin(i + 2))[7])


def test_top_n_counts_what_was_never_kept(spark):
    known = spark.createDataFrame([("b",), ("a",), ("c",)], "tool string")
    counts = spark.createDataFrame([("c", 5), ("other", 9)], "tool string, n bigint")
    assert [tuple(r) for r in sampling.top_n(counts, "tool", 2, known).collect()] == [("c", 5), ("a", 0)]
    with pytest.raises(ValueError):
        sampling.top_n(counts, "tool", 4, known)


def test_jobs(spark, tmp_path):
    df = spark.createDataFrame([("0:base, 1:distilled,",)], "spec string")
    assert sorted(jobs.parse_jobs(df, ["seed", "condition"]).collect()) == [(0, "base"), (1, "distilled")]
    with pytest.raises(Exception, match="malformed"):
        jobs.parse_jobs(spark.createDataFrame([("x:base",)], "spec string"), ["seed", "condition"]).collect()
    todo = spark.range(4).withColumnRenamed("id", "i")
    got = jobs.run_jobs(todo, todo.where("i = 0"), ["i"], lambda j: None, budget_s=2, clock=iter(range(10)).__next__)
    assert [j["i"] for j in got["skipped"]] == [0] and [j["i"] for j in got["ran"]] == [1] and [j["i"] for j in got["deferred"]] == [2, 3]
    done = []
    for _ in range(2):
        jobs.run_stage(spark, str(tmp_path), "prepare", lambda: done.append(1))
    assert done == [1]
    config = {"a": {"b": 1}, "seed": 0}
    assert jobs.resolve_config(config, {"a.b": 2}, {"a.b": 3}, 9) == {"a": {"b": 3}, "seed": 9} and config["a"]["b"] == 1
    with pytest.raises(KeyError):
        jobs.set_path(config, "a.c", 1)


def test_stream_equals_batch(spark, tmp_path):
    from stepwell.streaming import events

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):  # a second run finds nothing new
        events.process_new(events.stream_of(spark, str(tmp_path / "in"), src.schema), lambda df, i: seen.append(df.count()), str(tmp_path / "ck"))
    assert sum(seen) == src.count()
    stream = events.windowed(events.stream_of(spark, str(tmp_path / "in"), src.schema, 100), "1 hour", late="1 day")
    stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == src.count()
