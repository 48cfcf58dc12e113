"""Multi-step episodes: a model calls tools until the chain is done or a step fails for good.

An episode is a log of attempts.  Each answer of the model is classified by an
ordered list of tests (``CHECKS``) into an attempt; ``position`` folds the log
into the step that is due and the number of its attempts, and a step's record is
a summary of its part of the log.  So the state of an episode is its messages and
its log and nothing else, and many episodes can wait for one batch of answers.

An episode depends on nothing but its task, so tasks are mapped in Arrow batches
without a shuffle; the model is an injected function.  The same function serves a
stream of tasks through ``mapInArrow``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tool_tables as T
from ..functions.algebra import ToolFailure
from ..functions.tools import DESCRIPTIONS, call_plain, schema_of
from ..functions.values import same_call_arguments

Model = Callable[[list[dict]], str]
BatchModel = Callable[[list[list[dict]]], list[str]]
RETRIES = 2

_CALL = re.compile(r"<tool_call>\s*(\{.*?\})\s*</tool_call>", re.S)
STATE = "task_id string, chain_length int, injected_error_at_step int, success boolean, steps array<struct<step_index: int, tool_name: string, succeeded: boolean, recovered_from_error: boolean, error: string, error_type: string, arguments_match: boolean>>, messages array<struct<role: string, content: string>>"
_STEP = pa.struct([("step_index", pa.int32()), ("tool_name", pa.string()), ("succeeded", pa.bool_()), ("recovered_from_error", pa.bool_()), ("error", pa.string()), ("error_type", pa.string()), ("arguments_match", pa.bool_())])
_MESSAGE = pa.struct([("role", pa.string()), ("content", pa.string())])
_STATES = pa.schema([("task_id", pa.string()), ("chain_length", pa.int32()), ("injected_error_at_step", pa.int32()), ("success", pa.bool_()), ("steps", pa.list_(_STEP)), ("messages", pa.list_(_MESSAGE))])


def system_prompt(tools: dict[str, tuple[str, ...]]) -> str:
    """The tools with their descriptions and argument schemas, and how to call one."""
    lines = [f"- {n}: {DESCRIPTIONS.get(n, n)} Arguments: {json.dumps(schema_of(a))}" for n, a in tools.items()]
    return "\n".join(["You can use these tools, one call at a time:", *lines, 'Answer with <tool_call>{"name": ..., "arguments": {...}}</tool_call>; the result, or an error that you may react to, comes back.'])


@dataclass
class Answer:
    """What a model said at a place of an episode; ``call`` is the JSON it holds, or why there is none."""

    text: str
    due: str | None  # the tool that is expected, if any
    tools: dict[str, tuple[str, ...]]
    injected: bool  # whether this attempt is made to fail

    def __post_init__(self):
        found = _CALL.search(self.text)
        self.problem, self.call = None, {}
        try:
            self.call = json.loads(found[1]) if found else {}
        except ValueError:
            self.problem = "invalid JSON"
        if not found:
            self.problem = "a final answer where a call was due"
        elif not self.problem and not isinstance(self.call.get("name"), str):
            self.problem = "no name"
        elif not self.problem and not isinstance(self.arguments, dict):
            self.problem = "arguments are no object"

    @property
    def name(self) -> str | None:
        return None if self.problem else self.call["name"]

    @property
    def arguments(self):
        return self.call.get("arguments", {})


#: What can be wrong with an answer, in the order in which it is told: (error class, test, message).
CHECKS = [
    ("MalformedCallError", lambda a: a.problem is not None, lambda a: a.problem),
    ("WrongToolError", lambda a: a.due not in (None, a.name), lambda a: f"{a.due} was due, not {a.name}"),
    ("UnknownToolError", lambda a: a.name not in a.tools, lambda a: f"no tool {a.name}"),
    ("ToolExecutionError", lambda a: a.injected, lambda a: "simulated failure"),
]


@dataclass
class Attempt:
    step: int
    tool: str | None
    error_type: str | None
    reply: str  # the tool's result, or what went wrong
    matched: bool | None  # whether the first attempt's arguments are the expected ones


@dataclass
class Episode:
    """A task, the messages so far and the log of attempts."""

    task: dict
    tools: dict[str, tuple[str, ...]]
    retries: int = RETRIES
    messages: list[dict] = field(default_factory=list)
    log: list[Attempt] = field(default_factory=list)

    def __post_init__(self):
        said = (("system", system_prompt(self.tools)), ("user", self.task["user_goal"]))
        self.messages = self.messages or [{"role": r, "content": c} for r, c in said]

    def position(self) -> tuple[int, int] | None:
        """(step that is due, attempts made at it); None once the episode is over."""
        done = sum(a.error_type is None for a in self.log)
        tries = sum(a.step == done for a in self.log)
        return None if done == self.task["chain_length"] or tries > self.retries else (done, tries)

    def _expected(self, what: str, step: int):
        return dict(enumerate(self.task.get(what) or ())).get(step)

    def take(self, text: str) -> None:
        """Enters the model's answer to the messages so far."""
        step, tries = self.position()
        due, wanted = self._expected("expected_tool_sequence", step), self._expected("expected_arguments", step)
        answer = Answer(text, due, self.tools, tries == 0 and step == self.task.get("injected_error_at_step"))
        wrong = next(((kind, tell(answer)) for kind, test, tell in CHECKS if test(answer)), None)
        if wrong is None:
            try:
                wrong, reply = None, json.dumps(call_plain(answer.name, answer.arguments))
            except ToolFailure as e:
                wrong = (e.kind, str(e))
        kind, reply = wrong or (None, reply)
        fits = None if wanted is None else tries == 0 and answer.name == due and same_call_arguments(answer.arguments, json.loads(wanted))
        self.log.append(Attempt(step, answer.name, kind, reply, fits))
        self.messages += [{"role": "assistant", "content": text}, {"role": "tool", "content": reply if kind is None else f"ERROR: {reply}"}]

    def state(self) -> dict:
        steps = []
        for k, part in groupby(self.log, lambda a: a.step):
            part = list(part)
            end, ok = part[-1], part[-1].error_type is None
            named = [a.tool for a in part if a.tool is not None]
            steps.append({
                "step_index": k, "tool_name": named[-1] if named else None, "succeeded": ok, "recovered_from_error": ok and len(part) > 1,
                "error": None if ok else end.reply, "error_type": end.error_type, "arguments_match": part[0].matched,
            })
        won = sum(s["succeeded"] for s in steps) == self.task["chain_length"]
        return {**{k: self.task.get(k) for k in ("task_id", "chain_length", "injected_error_at_step")}, "success": won, "steps": steps, "messages": self.messages}


def play(episode: Episode, model: Model) -> Episode:
    while episode.position():
        episode.take(model(episode.messages))
    return episode


def play_batched(episodes: list[Episode], model: BatchModel, max_batch: int) -> list[Episode]:
    """All episodes in rounds: in each, those that go on are answered in batches of at most ``max_batch``.

    The order is kept.  A model that gives another number of answers than it was
    asked for, or fails, fails the whole batch of tasks.
    """
    while waiting := [e for e in episodes if e.position()]:
        for k in range(0, len(waiting), max_batch):
            asked = waiting[k : k + max_batch]
            answers = model([e.messages for e in asked])
            if len(answers) != len(asked):
                raise ValueError(f"{len(answers)} answers to {len(asked)} requests")
            for e, text in zip(asked, answers):
                e.take(text)
    return episodes


_TASK = ("task_id", "chain_length", "user_goal", "expected_tool_sequence", "injected_error_at_step", "expected_arguments")


def _states_of(tasks: DataFrame, played: Callable[[list[dict]], list[Episode]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([e.state() for e in played(batch.to_pylist())], _STATES)

    return tasks.select(*_TASK).mapInArrow(run, STATE)


def run_tasks(tasks: DataFrame, make_model: Callable[[dict], Model], tools: dict[str, tuple[str, ...]], retries: int = RETRIES) -> DataFrame:
    """States of all tasks (batch or stream).  make_model: a picklable function of the task."""
    return _states_of(tasks, lambda rows: [play(Episode(t, tools, retries), make_model(t)) for t in rows])


def run_tasks_batched(tasks: DataFrame, make_model: Callable[[], BatchModel], tools: dict[str, tuple[str, ...]], max_batch: int, retries: int = RETRIES) -> DataFrame:
    """The same with a model that answers many histories at once; each Arrow batch of tasks is played together.

    make_model: a picklable function that loads the model, called in the worker.
    """
    return _states_of(tasks, lambda rows: play_batched([Episode(t, tools, retries) for t in rows], make_model(), max_batch))


# Arguments that every tool accepts.
VALID_ARGUMENTS = {
    "get_weather": {"city": "Paris"}, "calculator": {"expression": "1 + 1"}, "search_knowledge_base": {"query": "lora"}, "get_current_time": {"timezone": "UTC"},
    "convert_temperature": {"value": 20, "from_unit": "C", "to_unit": "F"}, "compare_numbers": {"a": 1, "b": 2}, "get_population": {"country": "France"}, "get_capital": {"country": "France"},
    "get_elevation": {"place": "Everest"}, "convert_length": {"value": 1, "from_unit": "km", "to_unit": "m"}, "average_numbers": {"a": 1, "b": 2}, "round_number": {"value": 1.234, "decimals": 1},
    "calculate_distance": {"origin": "Paris", "destination": "Rome"}, "convert_currency": {"amount": 5, "from_currency": "usd", "to_currency": "eur"}, "get_stock_price": {"symbol": "AAPL"},
    "calculate_discount": {"original_price": 10, "discount_percentage": 5}, "calculate_bmi": {"height": 1.8, "weight": 75}, "calculate_tip": {"bill_amount": 20, "tip_percentage": 15},
    "calculate_age": {"birthdate": "1990-09-08"}, "generate_random_number": {"min": 1, "max": 6},
}


def scripted(task: dict) -> Model:
    """A model that always makes the call that is due, with valid arguments."""
    due = list(task["expected_tool_sequence"])

    def answer(messages: list[dict]) -> str:
        done = sum(m["role"] == "tool" and not m["content"].startswith("ERROR") for m in messages)
        name = due[min(done, len(due) - 1)]
        return f"<tool_call>{json.dumps({'name': name, 'arguments': VALID_ARGUMENTS[name]})}</tool_call>"

    return answer


def careless(task: dict) -> Model:
    """The same, but from the third step on it answers in words."""
    good = scripted(task)
    return lambda messages: good(messages) if sum(m["role"] == "tool" for m in messages) < 2 else "All done."


def talker(task: dict) -> Model:
    """A model that never calls a tool."""
    return lambda messages: "Let me think about it."


def even_caller() -> BatchModel:
    """A batch model for single turns: a call for even numbers, broken JSON for odd ones."""
    return lambda prompts: ['<tool_call>{"name": "f", "arguments": {"k": 1}}</tool_call>' if int(p[-1]["content"]) % 2 == 0 else "<tool_call>{broken}</tool_call>" for p in prompts]


def episode_gate(outputs: DataFrame, max_failures: int) -> DataFrame:
    """Fails the query if more than ``max_failures`` outputs hold no call; else their number."""
    bad = F.count(F.when(~F.col("output").rlike(r"(?s)<tool_call>\s*\{.*?\}\s*</tool_call>"), 1))
    return outputs.agg(bad.alias("n")).select(F.when(F.col("n") > max_failures, F.raise_error(F.concat(F.lit("outputs without a call: "), F.col("n").cast("string"))).cast("long")).otherwise(F.col("n")).alias("n_failures"))


TOOLS = {"c": T.DEMO_TOOLS, "x": T.EXTENDED_TOOLS}
