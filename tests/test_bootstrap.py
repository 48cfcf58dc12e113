"""Bootstraps by weights against the form that joins every slot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwell.functions import stats


def draws_of(df):
    return {r["draw"]: r["difference"] for r in df.collect()}


def cells(spark):
    rng = np.random.default_rng(0)
    rows = [(int(s), f"t{t}", float(rng.normal()), float(rng.normal())) for s in range(4) for t in range(7) if (s + t) % 3 for _ in range(3)]
    return spark.createDataFrame(rows + [(None, "t1", 1.0, 1.0), (1, None, 1.0, 1.0), (9, "é", None, 1.0)], "seed int, template string, d double, e double")


def test_weights_equal_joined_slots(spark, monkeypatch):
    rows = cells(spark)
    whole = draws_of(stats.crossed_bootstrap(rows, "d", "seed", "template", 300, 5))
    pairs = draws_of(stats.template_bootstrap(rows, "d", "e", "template", 300, 7))
    monkeypatch.setattr(stats, "MAX_CELLS", 3)
    assert whole == pytest.approx(draws_of(stats.crossed_bootstrap(rows, "d", "seed", "template", 300, 5)))
    assert pairs == pytest.approx(draws_of(stats.template_bootstrap(rows, "d", "e", "template", 300, 7)))


def test_weights_are_the_drawn_indices(spark):
    own = stats.draw_weights(5, np.arange(3), 4, "seed")
    df = spark.range(3).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("i", stats.draw_index(5, F.lit(4), F.lit("seed"), F.col("id"), F.col("slot")))
    assert own.sum() == 12 and {(r["id"], r["i"]): r["count"] for r in df.groupBy("id", "i").count().collect()} == {(d, i): int(own[d, i]) for d in range(3) for i in range(4) if own[d, i]}


def test_no_slot_is_a_row(spark):
    plan = stats.crossed_bootstrap(cells(spark), "d", "seed", "template", 100, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_draws_over_nothing(spark):
    assert stats.crossed_bootstrap(cells(spark).limit(0), "d", "seed", "template", 5, 1).count() == 0
    assert stats.template_bootstrap(cells(spark).limit(0), "d", "e", "template", 5, 1).count() == 0
