import json

from pyspark.sql import functions as F

from stepwell.functions.tool_tables import DEMO_TOOLS
from stepwell.operators import metrics
from stepwell.plans.tasks import task_set
import pytest

from stepwell.streaming import episodes
from stepwell.streaming.episodes import TOOLS, Episode, run_tasks, run_tasks_batched, scripted

CALL = '<tool_call>{"name": "%s", "arguments": %s}</tool_call>'


def play(answers, **task):
    it = iter(answers)
    task = {"task_id": "t", "chain_length": 1, "user_goal": "g", "expected_tool_sequence": ["calculator"], "injected_error_at_step": None, "expected_arguments": None} | task
    return episodes.play(Episode(task, DEMO_TOOLS), lambda messages: next(it)).state()


def test_all_tasks_complete(spark):
    for kind, n in (("c", 121), ("x", 158)):
        states = run_tasks(task_set(spark, kind), scripted, TOOLS[kind])
        rows = metrics.result_rows(states, F.lit("a"), F.lit("b"))
        got = metrics.summarize(rows).first()
        assert got["n_tasks"] == n and got["full_chain_success_rate"] == 1.0 and got["recovery_rate"] == 1.0
        recovered = rows.select("injected_error_at_step", F.explode("steps").alias("s")).where("s.recovered_from_error <> (s.step_index <=> injected_error_at_step)")
        assert recovered.count() == 0


def test_batched_equals_sequential(spark):
    tasks = task_set(spark, "c").where("chain_length = 3")
    by_goal = {r["user_goal"]: r.asDict() for r in tasks.collect()}

    def model():
        of = {g: scripted(t) for g, t in by_goal.items()}

        def answer(histories):
            assert len(histories) <= 8
            return [of[h[1]["content"]](h) for h in histories]

        return answer

    one, many = run_tasks(tasks, scripted, TOOLS["c"]), run_tasks_batched(tasks, model, TOOLS["c"], 8)
    assert sorted(one.collect()) == sorted(many.collect())
    with pytest.raises(ValueError, match="answers to"):
        episodes.play_batched([Episode(t, DEMO_TOOLS) for t in by_goal.values()], lambda h: ["x"] * (len(h) - 1), 8)


def test_prompt_tells_every_tool():
    prompt = episodes.system_prompt(TOOLS["x"])
    assert all(f"- {n}: " in prompt and f'"{a}"' in prompt for n, args in TOOLS["x"].items() for a in args)


def test_sets_are_disjoint(spark):
    a, b = (task_set(spark, k).select("task_id") for k in ("c", "x"))
    assert a.intersect(b).count() == 0 and a.distinct().count() == 121


def test_state_machine():
    good = CALL % ("calculator", '{"expression": "1 + 1"}')
    assert play([good])["success"]
    late = play(["no call", good])
    assert late["success"] and late["steps"][0]["recovered_from_error"]
    wrong = play([CALL % ("nothing", "{}")] * 3)
    assert not wrong["success"] and wrong["steps"][0]["error_type"] == "WrongToolError" and wrong["steps"][0]["tool_name"] == "nothing"
    assert play(["done"] * 3)["steps"][0]["error_type"] == "MalformedCallError"
    assert play([CALL % ("nothing", "{}")] * 3, expected_tool_sequence=[])["steps"][0]["error_type"] == "UnknownToolError"
    assert play([CALL % ("calculator", '{"x": 1}')] * 3)["steps"][0]["error_type"] == "ToolArgumentError"
    hit = play([good, good], injected_error_at_step=0)
    assert hit["success"] and hit["steps"][0]["recovered_from_error"]
    chain = play(["done"] * 3, chain_length=3, expected_tool_sequence=["calculator"] * 3)
    assert len(chain["steps"]) == 1 and not chain["success"]


def test_argument_match():
    wanted = json.dumps({"expression": "1 + 1"})
    assert play([CALL % ("calculator", '{"expression": " 1 + 1"}')], expected_arguments=[wanted])["steps"][0]["arguments_match"] is True
    assert play([CALL % ("calculator", '{"expression": "2"}')], expected_arguments=[wanted])["steps"][0]["arguments_match"] is False
    assert play([CALL % ("calculator", '{"expression": "2"}')])["steps"][0]["arguments_match"] is None
