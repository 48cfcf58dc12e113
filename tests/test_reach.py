"""Operators that no registered query needs, each on a small case."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwell.functions import losses, numbers, stats
from stepwell.operators import checker, joins, layers, metrics, prepare
from stepwell.plans import jobs, runs
from stepwell.plans.tasks import from_prepared
from stepwell.sources import configs, readers, remote, writers
from stepwell.streaming import episodes


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_statistics_text(spark):
    df = rows(spark, [(8, 10), (0, 0)], "k int, n int")
    assert df.select(stats.cell(F.col("k"), F.col("n"))).first()[0].split() == ["80.0%", "(8/10)", "[49.0-94.3]"]
    draws = rows(spark, [(i, i / 1000 - 0.05) for i in range(101)], "draw int, difference double")
    assert stats.equivalent(draws, 0.05).first()[0] and not stats.equivalent(draws, 0.04).first()[0]


def test_checked_joins(spark):
    known = rows(spark, [("a", 1)], "tool string, size int")
    assert joins.require(rows(spark, [("a",)], "tool string"), known, "tool", "tool").first()["size"] == 1
    with pytest.raises(Exception, match="unknown tool: b"):
        joins.require(rows(spark, [("b",)], "tool string"), known, "tool", "tool").collect()
    a, b = rows(spark, [("eos", "1"), ("ids", "[1]")], "field string, value string"), rows(spark, [("eos", "2"), ("ids", "[1]")], "field string, value string")
    assert joins.tokenizers_agree(a, a).first()[0] is True and joins.tokenizers_agree(a, b).first()["differing"] == ["eos"]
    goals = rows(spark, [(f"t{i}", f"g{i}") for i in range(9)], "task_id string, user_goal string")
    assert joins.probe_texts(goals, 4, 1).count() == 4 and joins.probe_texts(goals, 4, 1).collect() == joins.probe_texts(goals.repartition(3), 4, 1).collect()


def test_retries():
    waits, fails = [], iter([OSError, OSError])

    def save():
        for e in fails:
            raise e("no")

    assert joins.with_retries(save, sleep=waits.append) and waits == [5.0, 10.0]
    assert not joins.with_retries(lambda: (_ for _ in ()).throw(OSError("no")), sleep=waits.append)


def test_gate_and_training_rows(spark):
    said = rows(spark, [("<tool_call>{}</tool_call>",), ("words",)], "output string")
    assert episodes.episode_gate(said, 1).first()[0] == 1
    with pytest.raises(Exception, match="outputs without a call: 1"):
        episodes.episode_gate(said, 0).collect()
    ids = rows(spark, [([1, 2], [1, 2, 3, 9, 4])], "p array<int>, f array<int>")
    made = ids.select(losses.training_example(F.col("p"), F.col("f")).alias("e"), losses.cut_at_eos(F.col("f"), 9).alias("cut")).first()
    assert made["e"]["labels"] == [losses.IGNORED] * 2 + [3, 9, 4] and made["cut"] == [1, 2, 3, 9]
    with pytest.raises(Exception, match="does not begin"):
        ids.select(losses.training_example(F.col("f"), F.col("p"))).collect()


def test_layers(spark):
    tokens = rows(spark, [(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, [0.0, 1.0])], "s int, vec array<double>")
    assert {r["s"]: r["vec"] for r in layers.mean_pool(tokens, "s").collect()} == {1: [2.0, 4.0], 2: [0.0, 1.0]}
    names = rows(spark, [("m.layers.10",), ("m.layers.2",), ("m.layers.2.mlp",), ("embed",)], "name string")
    assert [r["layer"] for r in layers.layer_numbers(names).collect()] == [2, 10]
    rng = np.random.default_rng(3)
    data = [(c, "in", layer, "ffn", i, rng.normal(size=4).tolist()) for c in ("x", "y") for layer in (0, 1) for i in range(6)]
    schema = "condition string, input_set string, layer int, stream string, sample_id int, vec array<double>"
    students = rows(spark, data, schema)
    teachers = rows(spark, [r[1:] for r in data if r[0] == "x"], schema.split(", ", 1)[1])
    got = layers.compare_conditions(students, teachers, layers.align_layers(spark, 2, 2)).collect()
    assert len(got) == 4 and all(r["cka"] == pytest.approx(1) and r["cosine_distance"] == pytest.approx(0, abs=1e-9) for r in got if r["condition"] == "x")


def test_readers_and_writers(spark, tmp_path):
    text = rows(spark, [('{"a": 1}\n\n{"a": 2}',)], "t string")
    assert [tuple(r) for r in readers.jsonl_of_text(text, "t", "a int").collect()] == [(0, 1), (2, 2)]
    for k in (0, 1):
        (tmp_path / f"seed{k}_x.json").write_text(json.dumps([{"a": k}, {"a": 9}]))
    assert readers.read_json_arrays(spark, f"{tmp_path}/seed*_*.json", "a int").select("file").distinct().count() == 2
    spark.range(20).select(F.col("id").alias("source_index"), F.col("id").cast("string").alias("text")).write.parquet(f"{tmp_path}/p")
    assert readers.read_prefix(spark, f"{tmp_path}/p", 3).count() == 3
    assert [r["text"] for r in readers.first_texts(spark.read.parquet(f"{tmp_path}/p"), 2).collect()] == ["0", "1"]
    vectors = rows(spark, [(0, "ffn", 1, [1.0]), (1, "attn", 1, [2.0])], "layer int, stream string, sample_id int, vec array<double>")
    back = readers.read_activations(spark, writers.write_activations(vectors, f"{tmp_path}/act"))
    assert back.where("layer = 1").first()["stream"] == "attn"
    assert tuple(readers.activation_key(rows(spark, [("layer3__ffn",)], "key string")).select("layer", "stream").first()) == (3, "ffn")
    for k in (1, 2):
        writers.append_log(rows(spark, [(k,)], "step int"), f"{tmp_path}/log")
        writers.write_partition(rows(spark, [(k, 0), (3, k)], "job int, v int"), f"{tmp_path}/jobs", "job")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/jobs").select("job", "v").collect()} == {(1, 0), (2, 0), (3, 2)}


def test_tasks_by_source(spark, tmp_path):
    assert readers.load_tasks(spark, 3, "synthetic").count() == 40 and readers.load_tasks(spark, 1, "synthetic_ext").count() == 30
    record = {"task_id": "corpus-1", "chain_length": 1, "user_goal": "g", "expected_tool_sequence": ["calculator"], "injected_error_at_step": None, "arguments": '{"expression": "1"}', "arguments_style": "missing", "source_index": 1}
    (tmp_path / "train.jsonl").write_text(json.dumps(record) + "\n")
    tasks = readers.load_tasks(spark, 1, "corpus_train", f"{tmp_path}/train.jsonl")
    assert tasks.first()["expected_arguments"] == ['{"expression": "1"}'] and from_prepared(tasks.withColumn("arguments", F.lit("{}"))).count() == 1
    for bad in ((2, "synthetic"), (1, "other")):
        with pytest.raises(ValueError):
            readers.load_tasks(spark, *bad)
    with pytest.raises(FileNotFoundError):
        readers.load_tasks(spark, 1, "corpus_test")


def test_names_and_paths(spark):
    df = rows(spark, [("lr_low@n200", "a-b-3"), ("plain", "x")], "s string, t string")
    got = df.select(jobs.sweep_name(F.col("s")).alias("n"), numbers.template_of(F.col("t")).alias("t"), jobs.split_key(jobs.fold_key(F.lit("0"), F.lit("base"), F.lit("a:b"))).alias("k")).collect()
    assert [tuple(r["n"]) for r in got] == [("lr_low", 200), ("plain", None)] and [r["t"] for r in got] == ["a-b", "x"] and got[0]["k"] == ["0", "base", "a:b"]
    assert jobs.result_path("r/", "eval", seed=1, condition="base", sweep=None) == "r/eval/seed=1/condition=base"
    assert rows(spark, [(["b", "a"],)], "k array<string>").select(prepare.canonical(F.col("k"))).first()[0] == ["a", "b"]


def test_examples_and_prompts(spark):
    questions = rows(spark, [("1", [[("system", "s"), ("user", "u1"), ("user", "u2")]], [("f", "does", "{}")], 0), ("2", [[("user", "x")]], [], 1), ("3", [[("user", "x")]], [], 2)], "id string, question array<array<struct<role: string, content: string>>>, function array<struct<name: string, description: string, parameters: string>>, ord int")
    answers = rows(spark, [("1", ["old"], 0), ("1", ["new"], 1), ("2", ["a", "b"], 2)], "id string, ground_truth array<string>, ord int")
    got = checker.join_examples(questions, answers).withColumn("prompt", checker.build_prompt(F.col("function"), F.col("user_message"))).collect()
    assert [(r["id"], r["truth"], r["user_message"]) for r in got] == [("1", "new", "u1\nu2")]
    assert "f: does" in got[0]["prompt"][0]["content"] and got[0]["prompt"][1]["content"] == "u1\nu2"
    assert checker.accuracy(rows(spark, [("a", True), ("a", False)], "c string, success boolean"), "c").first()["accuracy"] == 0.5


def test_configs(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"general_lm_eval": {"n": 3}, "conditions": [{"id": "base", "checkpoint": "ck/base"}]}))
    config = configs.load_config(tmp_path / "c.json")
    assert configs.general_eval_section(config) == {"n": 3} and configs.checkpoint_of(config, "base", "/r/") == "/r/ck/base"
    with pytest.raises(ValueError, match="base"):
        configs.checkpoint_of(config, "other")
    with pytest.raises(KeyError, match="conditions"):
        configs.section(config, "nothing")


def test_remote(tmp_path):
    assert remote.Remote.of({}) is None and remote.Remote.of({"STEPWELL_REMOTE": "x"}) is None
    store = remote.Remote.of({"STEPWELL_REMOTE": f"{tmp_path}/store", "STEPWELL_RUN": "r1"})
    store.check()
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.txt").write_text("kept")
    assert store.push({"results": f"{tmp_path}/out"}) and store.restore({"results": f"{tmp_path}/back"})
    assert (tmp_path / "back" / "a.txt").read_text() == "kept"
    assert not store.push({"results": f"{tmp_path}/missing"}) and not store.restore({"other": f"{tmp_path}/b2"})


def test_outputs_of_a_run(spark, tmp_path):
    sets = {"unseen_tools": (readers.load_tasks(spark, 3, "synthetic"), episodes.TOOLS["c"])}
    made = runs.evaluate_condition("distilled", sets, episodes.scripted)
    perplexity = rows(spark, [("distilled", 12.5)], "condition string, perplexity double")
    summary = runs.write_evaluation(made, perplexity, f"{tmp_path}/out").collect()
    assert [(r["condition"], r["n_tasks"], r["perplexity"], r["full_chain_success_rate"]) for r in summary] == [("distilled", 40, 12.5, 1.0)]
    assert readers.read_results(spark, f"{tmp_path}/out/eval_results").count() == 40 == readers.read_results_csv(spark, f"{tmp_path}/out/eval_results_csv").count()


def test_a_workers_job(spark, tmp_path):
    gone, sent = [], []

    def send(job):
        sent.append(job)
        raise OSError("no network")

    evaluate = lambda job, path: rows(spark, [("t", path)], "task_id string, path string")
    runs.run_job(spark, {"seed": 1, "condition": "base"}, lambda job: "ck1", evaluate, gone.append, f"{tmp_path}/r", send)
    assert tuple(spark.read.parquet(f"{tmp_path}/r").first()) == ("t", "ck1", 1, "base") and gone == ["ck1"] and sent
    with pytest.raises(ZeroDivisionError):
        runs.run_job(spark, {"seed": 2}, lambda job: "ck2", lambda job, path: 1 / 0, gone.append, f"{tmp_path}/r2")
    assert gone == ["ck1", "ck2"]


def test_no_rows_no_rate(spark):
    assert metrics.generation_stats(rows(spark, [("a", 3), ("a", 1), ("a", 3), ("a", 8), ("b", 2)], "g string, n_tokens int"), "g").orderBy("g").collect()[0]["median"] == 3
