"""Bucketed activation caches, and runs that are committed whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwell.operators import layers
from stepwell.sources import caches, commits

SCHEMA = "condition string, input_set string, layer int, stream string, sample_id int, vec array<double>"


def cache_rows(conditions, n_layers, width, seed):
    rng = np.random.default_rng(seed)
    return [(c, s, layer, "ffn", k, rng.normal(size=width).tolist()) for c in conditions for s in ("in", "out") for layer in range(n_layers) for k in range(8)]


def test_conditions_meet_their_teacher_without_a_shuffle(spark, tmp_path):
    data, own = cache_rows(["x", "y"], 4, 5, 1), cache_rows([None], 3, 6, 2)
    own = [r for r in own if r[1] == "in"]  # the teacher has one set only
    alignment = layers.align_layers(spark, 4, 3)
    caches.write_cache(spark.createDataFrame(data, SCHEMA), "cache_s", f"{tmp_path}/s", alignment, buckets=3)
    caches.write_cache(spark.createDataFrame(own, SCHEMA).drop("condition"), "cache_t", f"{tmp_path}/t", buckets=3)
    found = caches.compare_cached(spark, "cache_s", "cache_t", 5, 6)
    got = {(r["condition"], r["input_set"], r["source_layer"], r["target_layer"]): (r["cka"], r["cosine_distance"]) for r in found.collect()}
    to = {r["source_layer"]: r["target_layer"] for r in alignment.collect()}
    vec = lambda rows, c, layer: np.array([r[5] for r in rows if r[0] == c and r[1] == "in" and r[2] == layer])
    assert set(got) == {(c, "in", s, t) for c in ("x", "y") for s, t in to.items()}
    for (c, _, s, t), values in got.items():
        x, y = vec(data, c, s), vec(own, None, t)
        assert values == (pytest.approx(layers.cka(x, y)), pytest.approx(layers.rsa(x, y)))
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("SortMergeJoin") :]
    assert "Bucketed: true" in below and "Exchange" not in below
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        caches.write_cache(spark.createDataFrame(data, SCHEMA), "cache_s", f"{tmp_path}/again", alignment)


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    folder = f"{tmp_path}/run"
    good = spark.range(5).withColumn("v", F.lit("a"))
    bad = spark.range(5).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        commits.commit(spark, folder, "r", 0, {"rows": good, "summary": bad})
    assert commits.committed(spark, folder, "r") == []
    with pytest.raises(FileNotFoundError):
        commits.read_part(spark, folder, "r", "rows")
    assert commits.commit(spark, folder, "r", 0, {"rows": good, "summary": lambda: good.limit(1)})
    assert not commits.commit(spark, folder, "r", 0, {"rows": good.limit(2), "summary": bad})
    assert commits.commit(spark, folder, "r", 1, {"rows": good.limit(3)})
    assert commits.commit(spark, folder, "other", 0, {"rows": good.limit(1)})
    assert commits.read_part(spark, folder, "r", "rows").count() == 8 and commits.read_part(spark, folder, "r", "summary").count() == 1
    assert [m["batch"] for m in commits.committed(spark, folder, "r")] == [0, 1]
    assert commits.sweep(spark, folder) == 2  # what the failed attempt left of both tables
    assert commits.read_part(spark, folder, "r", "rows").count() == 8 and commits.sweep(spark, folder) == 0


def test_similarity_by_any_keys(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(12, 3)), rng.normal(size=(12, 4))
    df = spark.createDataFrame([("a", k % 2, p.tolist(), q.tolist()) for k, (p, q) in enumerate(zip(x, y))] + [(None, 0, [1.0] * 3, [1.0] * 4)], "c string, g int, x array<double>, y array<double>")
    got = {(r["c"], r["g"]): r["cka"] for r in layers.similarity_by(df, ["c", "g"], 3, 4).collect()}
    assert got == {("a", g): pytest.approx(layers.cka(x[g::2], y[g::2])) for g in (0, 1)}
