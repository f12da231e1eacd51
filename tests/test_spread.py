"""The work of a scenario lies in its frames and stretches, which are small: Spark alone puts them all into one task."""

import pytest
from pyspark.sql import functions as F

import flicker.plans.benchmark as B
from flicker.functions.methods import method
from flicker.queries.scenarios import _prepared

from .conftest import DATA


@pytest.fixture(scope="module")
def prepared(spark):
    return _prepared(spark, f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", ["flip10_cut20", "jitter050_cut20", "correlated10_cut20"])
def test_stretches_are_spread_over_tasks(prepared, name):
    cut = B.corrupted(prepared, B.scenarios_named(name)[0], "validation", [method("linear", t=4)], B.Config(validation_draws=2))
    of = cut.groupBy(F.spark_partition_id()).count().collect()
    total = sum(r["count"] for r in of)
    assert total == cut.select("run_id", "feature_id", "draw", "lo").distinct().count()
    assert len(of) >= 4 and max(r["count"] for r in of) <= total / 2


def test_frames_are_spread_over_files(prepared):
    assert prepared.frames.select(F.input_file_name()).distinct().count() >= 4


def test_more_cells_take_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 10)
    assert B.spread(spark.range(100), 1000, "id").rdd.getNumPartitions() == 100


def test_below_is_uniform_below_a_level(spark):
    from flicker.functions.scalars import below, uniform

    rows = spark.range(2000).select(F.col("id").cast("string").alias("k"), uniform("id").alias("u"))
    drawn = rows.first()["u"]
    for level in (-0.1, 0.0, 1e-9, 0.05, 0.1, 0.2, drawn, drawn + 2.0**-33, 0.5, 1.0, 2.0):
        assert rows.where(below(level, "k") != (F.col("u") < level)).count() == 0
    assert rows.where(below(drawn + 2.0**-33, "k") & (F.col("u") == drawn)).count() == 1
