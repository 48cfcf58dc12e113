"""Tiled Gram matrices against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwell.operators import gram, layers


def table_of(spark, x, y=None, layer=0):
    rows = [(layer, k, a.tolist(), (y if y is not None else x)[k].tolist()) for k, a in enumerate(x)]
    return spark.createDataFrame(rows, "layer int, sample_id long, vec array<double>, y array<double>")


def centred(x):
    g = x @ x.T
    return g - g.mean(0) - g.mean(1, keepdims=True) + g.mean()


@pytest.mark.parametrize("tile", [1, 3, 7, 1024])
def test_cells_equal_numpy_for_any_tile(spark, monkeypatch, tile):
    monkeypatch.setattr(gram, "TILE", tile)
    rng = np.random.default_rng(tile)
    x, z = rng.normal(size=(20, 10)), rng.normal(size=(9, 10))
    df = table_of(spark, x).unionByName(table_of(spark, z, layer=1)).repartition(3)
    got = gram.centered_gram(df, "layer").toPandas()
    for layer, own in ((0, x), (1, z)):
        cells = got[got.layer == layer].pivot(index="i", columns="j", values="k").to_numpy()
        assert cells == pytest.approx(centred(own))
    got = gram.triangle(df, "layer").toPandas()
    for layer, own in ((0, x), (1, z)):
        unit = own / np.linalg.norm(own, axis=1, keepdims=True)
        mine = got[got.layer == layer]
        assert len(mine) == len(own) * (len(own) - 1) // 2 and (mine.i < mine.j).all()
        assert mine.s.to_numpy() == pytest.approx((unit @ unit.T)[mine.i, mine.j])
        sums = gram.triangle_sums(df, "layer").where(F.col("layer") == layer).first()
        assert (sums["n_pairs"], sums["total"], sums["most"]) == (len(mine), pytest.approx(mine.s.sum()), pytest.approx(mine.s.max()))


def test_metrics_from_tiles_equal_those_from_sums(spark, monkeypatch):
    monkeypatch.setattr(gram, "TILE", 16)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=(50, 9))
    df = table_of(spark, x, y)
    assert gram.cka_by_tiles(df, "layer", x="vec").first()["cka"] == pytest.approx(layers.cka(x, y))
    assert gram.rsa_by_tiles(df, "layer", x="vec").first()["cosine_distance"] == pytest.approx(layers.rsa(x, y))
    constant = table_of(spark, x, np.ones((50, 2)))
    assert gram.cka_by_tiles(constant, "layer", x="vec").first()["cka"] == 0


def test_odd_groups(spark):
    schema = "layer int, sample_id long, vec array<double>"
    assert gram.centered_gram(spark.createDataFrame([], schema), "layer").count() == 0
    one = spark.createDataFrame([(0, 5, [1.0, 2.0]), (None, 1, [1.0]), (2, 1, None), (3, 7, [0.0, 0.0]), (3, 7, [0.0, 0.0])], schema)
    assert {(r["layer"], r["i"], r["j"], r["k"]) for r in gram.centered_gram(one, "layer").collect()} == {(0, 5, 5, 0.0), (3, 7, 7, 0.0)}
    sums = {r["layer"]: r for r in gram.triangle_sums(one, "layer").collect()}
    assert sums[0]["n_pairs"] == 0 and sums[0]["most"] is None and (sums[3]["n_pairs"], sums[3]["total"]) == (1, 0.0)
    with pytest.raises(Exception, match="different lengths"):
        gram.centered_norm(spark.createDataFrame([(0, 1, [1.0]), (0, 2, [1.0, 2.0])], schema).coalesce(1), "layer").collect()


def test_fifty_thousand_samples_of_a_layer(spark):
    n = 50_000
    vec = F.array(*(F.sin(F.col("id") * (k + 1.7)) for k in range(4)))
    df = spark.range(n).select(F.lit(0).alias("layer"), F.col("id").alias("sample_id"), vec.alias("vec"))
    x = np.array(df.select("vec").toPandas()["vec"].tolist())
    c = x - x.mean(0)
    assert gram.centered_norm(df, "layer").first()["norm"] == pytest.approx(np.linalg.norm(c.T @ c) ** 2, rel=1e-9)


def test_no_join_or_window_gathers_samples_of_a_layer(spark):
    df = table_of(spark, np.eye(8))
    plan = gram.centered_norm(df, "layer")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("block" in line and "vec" not in line for line in joins)
    assert "Cartesian" not in plan


def test_closest_pair_of_each_tile_alone(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3)).round(1) * rng.choice([1.0, 3.0], (90, 1))  # many pairs tie after rounding
    rows = [(layer, 100 * layer + k, v.tolist()) for layer, part in ((0, x), (1, x[::-1]), (2, -x[:1]), (3, [x[0], -x[0]])) for k, v in enumerate(part)]
    df = spark.createDataFrame(rows, "layer int, sample_id long, vec array<double>").repartition(3)
    monkeypatch.setattr(gram, "TILE", 16)
    cells = gram.triangle(df, "layer").withColumn("s", F.round("s", 6)).collect()
    want = {}
    for r in cells:
        want[r["layer"]] = min(want.get(r["layer"], (9, 0, 0)), (-r["s"], r["i"], r["j"]))
    got = {r["layer"]: (-r["s"], r["i"], r["j"]) for r in gram.closest(df, "layer").collect()}
    assert got == want and set(got) == {0, 1, 3}


@pytest.mark.parametrize("value", [0.9999994999, 0.9999995, 1.0, 0.1234565, -0.1234565, -0.5, 0.0, 2e-7, -3e-7])
def test_least_number_that_rounds_alike(spark, value):
    least = gram._least_that_rounds_to(value, 6)
    below = float(np.nextafter(least, -np.inf))
    got = spark.createDataFrame([(value, least, below)], "v double, l double, b double").select(*(F.round(c, 6) for c in "vlb")).first()
    assert got[0] == got[1] > got[2]
