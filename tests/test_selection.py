"""Exact ranks by passes over buckets, against sorting."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pagemill.operators import summaries


@pytest.mark.parametrize("kind", ["spread", "ties", "wide", "few"])
def test_median(spark, monkeypatch, kind):
    monkeypatch.setattr(summaries, "SELECT_BUCKETS", 16)
    monkeypatch.setattr(summaries, "SELECT_MOST", 5)
    rng = random.Random(3)
    values = {
        "spread": [rng.gauss(0, 9) for _ in range(300)],
        "ties": [float(rng.randrange(4)) for _ in range(301)],
        "wide": [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(100)] + [1.7e308, -1.7e308],
        "few": [2.0, 1.0],
    }[kind]
    rows = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "x double")
    assert summaries.exact_median(rows, F.col("x")) == statistics.median(values)
    for rank in (0, len(values) // 3, len(values) - 1):
        assert summaries.nth_value(rows, F.col("x"), rank) == sorted(values)[rank]


def test_nothing(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double")
    assert summaries.exact_median(rows, F.col("x")) is None and summaries.nth_value(rows, F.col("x"), 0) is None
    assert summaries.outliers(rows, "x", 1.2).filter('x < 0').count() == 0
