import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepwell.functions.parsing import calls_in, last_user_before, parse_output, scan
from stepwell.operators import prepare


@pytest.mark.parametrize(
    "chat, style, keys",
    [
        ("""<functioncall> {"name": "f", "arguments": '{"a": 1}'} <|end|>""", "string_single_quoted", ["a"]),
        ("""<functioncall> {"name": "f",\n "arguments": '{"a": 1,\n "b": "x"}'}""", "string_single_quoted", ["a", "b"]),
        ("""<functioncall> {"name": "f", "arguments": {"a": {"b": 2}}}""", "raw_object", ["a"]),
        ("""<functioncall> {"name": "f"}""", "missing", []),
        ("""<functioncall> {"name": "f", "arguments": "{'a': 1}"}""", "string_double_quoted", ["a"]),
    ],
)
def test_call_styles(chat, style, keys):
    found = calls_in(chat)
    assert found["error"] is None
    assert [(c["style"], c["arg_keys"]) for c in found["calls"]] == [(style, keys)]


@pytest.mark.parametrize("chat", ["""<functioncall> {"name": "f", "arguments": '{"a": "it's"}'}""", """<functioncall> {"name": "f" """, "<functioncall> f", """<functioncall> {"arguments": {}}""", """<functioncall> {"name": "f", "arguments": {"a": }}""", """<functioncall> {"name": "f", "arguments": '[1]'}"""])
def test_errors(chat):
    assert calls_in(chat)["calls"] is None


def test_no_and_two_calls():
    assert calls_in("nothing")["calls"] == [] and calls_in(None)["calls"] == []
    two = calls_in('<functioncall> {"name": "a"} x <functioncall> {"name": "b"}')["calls"]
    assert [c["name"] for c in two] == ["a", "b"] and two[1]["char_offset"] > two[0]["char_offset"]


def test_tags_and_quotes_inside_a_block():
    inside = calls_in("""<functioncall> {"name": "a", "arguments": {"x": "see <functioncall> {"}} y <functioncall> {"name": "b"}""")
    assert inside["calls"] is None  # braces in texts count
    inside = calls_in("""<functioncall> {"name": "a", "arguments": {"x": "see <functioncall>"}} y <functioncall> {"name": "b"}""")
    assert [c["name"] for c in inside["calls"]] == ["a", "b"]
    quoted = calls_in(r"""<functioncall> {"name": "a\"b", "arguments": '{}'}""")["calls"]
    assert quoted[0]["name"] == r"a\"b"


PIECES = ["<functioncall>", "<function", "call> ", " ", "\u00a0", "\x1c", "é", "{", "}", "}}", '{"name": "f"}', '{"name": "g", "arguments": {"x": "{}"}}', """{"name": "h", "arguments": '{"a": 1}'}""", "text"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join) | st.none(), max_size=5))
@example(["<function", "call> {}"])
@example(["<functioncall> {", '"name": "a"}'])
def test_a_batch_is_read_like_its_texts(texts):
    calls, errors = scan(pa.array(texts, pa.string()))
    assert [{"calls": c, "error": e} for c, e in zip(calls, errors)] == [calls_in(t) for t in texts]
    sliced = pa.array(["x", *texts, "y"], pa.string())[1:-1]
    assert scan(sliced) == (calls, errors)


def test_table_function_has_a_row_for_each_call(spark):
    chats = [None, "none", '<functioncall> {"name": "a"} é <functioncall> {"name": "b", "arguments": {"z": 1, "y": 2}}', "<functioncall> {"]
    raw = spark.createDataFrame(list(enumerate(chats)), "source_index int, chat string").repartition(2)
    got = sorted(tuple(r) for r in prepare.call_rows(raw).select("source_index", "nth", "name", "arg_keys", "char_offset", "error").collect() if r["error"] is None)
    assert got == [(2, 0, "a", [], 0, None), (2, 1, "b", ["y", "z"], 31, None)]
    assert [tuple(r) for r in prepare.call_rows(raw).where("error is not null").select("source_index", "nth", "error").collect()] == [(3, None, "unbalanced braces")]


def test_reasons_in_order(spark):
    call = """<functioncall> {"name": "click", "arguments": '{"k": 1}'}"""
    chats = {
        "parse_error": 'USER: a ASSISTANT: <functioncall> {"name"',
        "zero_calls": "USER: hello",
        "multi_call": f"USER: a ASSISTANT: {call} {call}",
        "tool_not_selected": call.replace("click", "other"),
        "non_canonical_args": "USER: a ASSISTANT: " + call.replace('"k"', '"z"'),
        "no_user_turn": "ASSISTANT: " + call,
        "empty_user_goal": "USER:  \n ASSISTANT: " + call,
        "ok": "USER: first ASSISTANT: which? USER: second one\nASSISTANT: " + call,
    }
    raw = spark.createDataFrame(list(enumerate(chats.values())), "source_index bigint, chat string")
    tools = spark.createDataFrame([("click", ["k"])], "tool string, canonical_args array<string>")
    got = prepare.classify(prepare.parse_corpus(raw), tools).orderBy("source_index").collect()
    assert [r["reason"] for r in got] == list(chats)
    assert got[-1]["goal"] == "second one"
    assert prepare.records(prepare.classify(prepare.parse_corpus(raw), tools)).count() == 1


def test_last_user_and_outputs(spark):
    df = spark.createDataFrame([("USER: a FUNCTION RESPONSE: b", 28)], "c string, o int")
    assert df.select(last_user_before(F.col("c"), F.col("o"))).first()[0] == "a"
    texts = [" hi ", '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>', '<tool_call>\n{"name": "f"}\n</tool_call>', "<tool_call>{bad}</tool_call>", '<tool_call>{"arguments": {}}</tool_call>', '<tool_call>{"name": "f", "arguments": [1]}</tool_call>']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_output(F.col("t")).alias("p")).select("p.*").collect()
    assert [r["kind"] for r in rows] == ["final", "call", "call", "malformed", "malformed", "malformed"]
    assert rows[0]["text"] == "hi" and rows[1]["arguments"] == '{"a":1}' and rows[2]["arguments"] == "{}"
