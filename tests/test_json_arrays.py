"""JSON arrays read by byte ranges, against the json module."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepwell.sources import json_arrays, readers, shared

TEXTS = st.text(alphabet='ab"\\,[]{}é\n\u65e5 ', max_size=12)
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | TEXTS, lambda v: st.lists(v, max_size=3) | st.dictionaries(TEXTS, v, max_size=3), max_leaves=8)


def by_ranges(path, size, split):
    state = depth = 0
    for a in range(0, size, split):
        r = json_arrays.Range(path, a, min(a + split, size), size, state, depth)
        yield from json_arrays.elements_of(r)
        _, _, _, _, _, state, change, _ = {m[4]: m for m in json_arrays.parity_of(r)}[state]
        depth += change


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, max_size=6), st.sampled_from([1, 2, 3, 5, 11, 10_000]), st.booleans(), st.sampled_from([None, 1]))
def test_any_split_gives_the_elements(tmp_path_factory, values, split, ascii_, indent):
    path = tmp_path_factory.mktemp("a") / "x.json"
    path.write_bytes(json.dumps(values, ensure_ascii=ascii_, indent=indent).encode())
    assert [json.loads(t) for _, t in by_ranges(str(path), path.stat().st_size, split)] == values


@pytest.mark.parametrize("content", [b"", b"[]", b" [ \n ] ", b"\xef\xbb\xbf[]"])
def test_arrays_of_nothing(spark, tmp_path, content):
    (tmp_path / "x.json").write_bytes(content)
    for split in (1, 2, 100):
        assert json_arrays.elements(spark, f"{tmp_path}/*.json", split).count() == 0


@pytest.mark.parametrize("content", [b"[1, 2", b'["a', b"{}", b"[1] 2", b"[1]]", b"[1}", b"[1, , 2]", b"[1, ]", b"[1][2]", b"7"])
def test_what_is_not_one_array_is_an_error(spark, tmp_path, content):
    (tmp_path / "x.json").write_bytes(content)
    for split in (3, 100):
        with pytest.raises(Exception, match="x.json"):
            json_arrays.elements(spark, f"{tmp_path}/x.json", split).collect()


def test_round_trip_by_tasks_and_ranges(spark, tmp_path):
    df = spark.range(500).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit('q"\\,]['), "id")).alias("text"), F.array(F.lit(None).cast("int"), F.col("id").cast("int")).alias("list"))
    json_arrays.write_json_arrays(df.repartition(4), f"{tmp_path}/out")
    assert sorted(p.suffix for p in (tmp_path / "out").iterdir()) == [".json"] * 4
    assert sum(len(json.loads(p.read_text())) for p in (tmp_path / "out").iterdir()) == 500
    back = json_arrays.read_json_arrays(spark, f"{tmp_path}/out/*.json", "id bigint, text string, list array<int>", 1001)
    assert back.select("file").distinct().count() == 4
    assert sorted(map(tuple, back.select("id", "text", "list").collect())) == sorted(map(tuple, df.collect()))
    order = [r["id"] for r in back.orderBy("file", "at").collect()]
    whole = [x["id"] for p in sorted((tmp_path / "out").iterdir()) for x in json.loads(p.read_text())]
    assert order == whole
    with pytest.raises(FileExistsError):
        json_arrays.write_json_arrays(df, f"{tmp_path}/out")


def test_a_failed_task_leaves_no_array(spark, tmp_path):
    bad = spark.range(20).repartition(2).select(F.when(F.col("id") == 13, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="no"):
        json_arrays.write_json_arrays(bad, f"{tmp_path}/out")
    assert not [p for p in (tmp_path / "out").glob("*.json") if not p.name.startswith(".")]


def test_one_large_array_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"a": k, "b": "," * (k % 50)} for k in range(5000)]))
    got = json_arrays.read_json_arrays(spark, f"{tmp_path}/x.json", "a int, b string", 20_000)
    assert got.rdd.getNumPartitions() > 5 and got.agg(F.sum("a"), F.sum(F.length("b"))).first() == (sum(range(5000)), sum(k % 50 for k in range(5000)))
    assert readers.read_json_arrays(spark, f"{tmp_path}/x.json", "a int").columns == ["a", "file"]


def test_later_answers_win(spark, tmp_path):
    (tmp_path / "q").write_text('{"id": "1", "question": [[{"role": "user", "content": "u"}]], "function": []}\nbroken\n')
    (tmp_path / "a").write_text('{"id": "1", "ground_truth": ["old"]}\n{"id": "1", "ground_truth": ["new"]}\n')
    assert [(r["id"], r["truth"]) for r in readers.read_examples(spark, f"{tmp_path}/q", f"{tmp_path}/a").collect()] == [("1", "new")]


def test_shared_folder(spark):
    assert shared.new_folder(spark, "x").startswith(shared.shared_folder(spark) + "/x-")
    assert shared.cut(spark.range(3)).count() == 3
