"""Bootstrap intervals with numpy's draws: those of one whole matrix, in little memory."""

import tracemalloc

import numpy as np
import pytest

from pagemill.operators import summaries


@pytest.mark.parametrize("n", [1, 7, 333])
def test_draws_are_those_of_one_matrix(n, monkeypatch):
    values = np.random.default_rng(5).normal(size=n)
    means = values[np.random.default_rng(0).integers(0, n, (300, n))].mean(1)
    tail = 100 * (1 - summaries.LEVEL) / 2
    for draws in (1, 1000, 1 << 20):
        monkeypatch.setattr(summaries, "DRAWS", draws, raising=False)
        assert summaries.interval(values, 300) == (values.mean(), *np.percentile(means, [tail, 100 - tail]))


def test_memory_is_that_of_a_resample():
    values = np.arange(50_000.0)
    tracemalloc.start()
    summaries.interval(values, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_groups(spark):
    rows = [("a", k, float(k * k % 17)) for k in range(50, 0, -1)] + [(None, 1, 3.0)]
    out = {r.g: tuple(r)[1:] for r in summaries.bootstrap_exact(spark.createDataFrame(rows, "g string, k bigint, v double"), "g", "k", "v").collect()}
    assert out == {"a": (50, *summaries.interval(np.array([k * k % 17 for k in range(1, 51)], float))), None: (1, 3.0, 3.0, 3.0)}
