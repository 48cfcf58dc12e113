"""Distinct counts, overlaps and frequent keys against plain Python, and lines that are broken."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from stepwell.operators import distinct, frequent
from stepwell.sources import readers


def keyed(spark, rows):
    return spark.createDataFrame(rows, "g string, k long").repartition(3)


def test_counts_are_exact_on_both_sides_of_the_sketch(spark):
    rows = [("small", k % 50) for k in range(200)] + [("large", k) for k in range(9000)] + [("large", None), (None, 3), (None, 4), ("empty", None)]
    df = keyed(spark, rows)
    got = {r["g"]: (r["rows"], r["n"]) for r in distinct.distinct_counts(df, "k", "g").collect()}
    assert got == {"small": (200, 50), "large": (9000, 9000), None: (2, 2), "empty": (0, 0)}
    bounds = {r["g"]: r for r in distinct.distinct_bounds(df, "k", "g").collect()}
    assert bounds["small"]["exact"] and (bounds["small"]["low"], bounds["small"]["high"]) == (50, 50)
    assert not bounds["large"]["exact"] and bounds["large"]["low"] < 9000 < bounds["large"]["high"] and bounds["large"]["high"] < 9600
    assert {r["g"]: r["unique"] for r in distinct.unique_keys(df, "k", "g").collect()} == {"small": False, "large": True, None: True, "empty": True}
    assert distinct.distinct_counts(df.limit(0), "k", "g").count() == 0


def test_overlaps_of_a_single_key_are_found(spark):
    n = 30_000
    rows = [("a", k) for k in range(n)] + [("b", n + k) for k in range(n)] + [("c", 2 * n + k) for k in range(n)] + [("c", 17)] + [("few", 5), ("few", -1), ("other", -2), (None, 5)]
    got = {(r["a"], r["b"]): (r["overlap"], r["by"]) for r in distinct.overlaps(keyed(spark, rows), "k", "g").collect()}
    names = ["a", "b", "c", "few", "other"]
    sets = {x: {k for g, k in rows if g == x} for x in names}
    assert {p: o for p, (o, _) in got.items()} == {(x, y): bool(sets[x] & sets[y]) for x in names for y in names if x < y}
    assert got["few", "other"] == (False, "sketch") and got["a", "b"] == (False, "keys") and got["a", "c"][0]


def plain_top(rows, n):
    counts = collections.Counter(k for k, _ in rows if k is not None)
    first = {}
    for k, at in rows:
        if k is not None:
            first[k] = min(at, first.get(k, at))
    return sorted(((k, c, first[k]) for k, c in counts.items()), key=lambda r: (-r[1], r[2], r[0]))[:n]


@pytest.mark.parametrize("counters", [2, 20, 4096])
@pytest.mark.parametrize("flat", [False, True])
def test_most_frequent_equals_counting_all(spark, monkeypatch, counters, flat):
    monkeypatch.setattr(frequent, "COUNTERS", counters)
    rng = random.Random(counters)
    rows = [(f"k{rng.randrange(300) if flat else int(rng.paretovariate(0.7)) % 300}", k % 500) for k in range(3000)] + [(None, 0)]
    df = spark.createDataFrame(rows, "k string, at int").repartition(3)
    assert [tuple(r) for r in frequent.most_frequent(df, "k", "at", 7).collect()] == plain_top(rows, 7)
    assert frequent.most_frequent(df.limit(0), "k", "at", 7).count() == 0


def test_only_candidates_are_counted(spark, monkeypatch):
    monkeypatch.setattr(frequent, "COUNTERS", 16)
    rows = [("hot", 1)] * 3000 + [("warm", 2)] * 1500 + [(f"x{k}", 3) for k in range(2000)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int")
    found = frequent.candidates(df, "k", 2)
    assert {"hot", "warm"} <= {r["key"] for r in found.collect()} and found.count() <= 32
    assert [r["k"] for r in frequent.most_frequent(df, "k", "at", 2).collect()] == ["hot", "warm"]


def test_broken_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"step": 1, "sft_loss": 0.5}\n{"step": \n\n{"step": "x"}\n{"step": 2}\n')
    (tmp_path / "b.jsonl").write_text("words\n")
    rows, broken = readers.read_loss_log(spark, f"{tmp_path}/*.jsonl", f"{tmp_path}/read")
    assert sorted(r["step"] for r in rows.collect()) == [1, 2] and "kd_loss" in rows.columns
    assert sorted((r["file"][-7:], r["broken_line"]) for r in broken.collect()) == [("a.jsonl", '{"step": '), ("a.jsonl", '{"step": "x"}'), ("b.jsonl", "words")]
    rows, broken = readers.read_layer_results(spark, f"{tmp_path}/b.jsonl", f"{tmp_path}/again")
    assert rows.count() == 0 and broken.count() == 1 and rows.columns[0] == "source_layer"
    assert broken.select(F.col("file")).first()[0].endswith("b.jsonl")
