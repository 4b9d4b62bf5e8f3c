"""Intervals by draws that merge: against numpy's bootstrap, and whatever the blocks."""

import numpy as np
from pyspark.sql import functions as F

from pagemill.operators import intervals


def test_draws_are_poisson_and_independent():
    w = intervals.draws(np.arange(5_000), 1, 2_000)
    assert abs(w.mean() - 1) < 0.002 and abs(w.var() - 1) < 0.005
    assert [round(float((w == k).mean()), 3) for k in range(4)] == [0.368, 0.368, 0.184, 0.061]
    assert np.abs(np.corrcoef(w[:, :200].T) - np.eye(200)).max() < 0.12  # rows
    assert np.abs(np.corrcoef(w[:200]) - np.eye(200)).max() < 0.08  # resamples


def test_intervals_are_numpys(spark):
    rng = np.random.default_rng(1)
    groups = {"wide": rng.normal(5, 3, 400), "skewed": rng.exponential(2, 900), None: rng.normal(0, 1, 60)}
    rows = [(g, i, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)] + [("wide", 10_000, None), ("wide", 10_001, float("nan"))]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {r["g"]: r for r in intervals.bootstrap(df, ["g"], F.col("k"), "v").collect()}
    for g, xs in groups.items():
        draws = np.random.default_rng(0)
        means = np.concatenate([xs[draws.integers(0, len(xs), (1000, len(xs)))].mean(1) for _ in range(10)])
        lo, hi = np.percentile(means, [2.5, 97.5])
        assert got[g]["n"] == len(xs) and abs(got[g]["mean"] - xs.mean()) < 1e-9
        assert abs(got[g]["lo"] - lo) < 0.04 * (hi - lo) and abs(got[g]["hi"] - hi) < 0.04 * (hi - lo), (g, got[g], lo, hi)


def test_blocks_change_nothing(spark):
    df = spark.range(300).select(F.lit("g").alias("g"), "id", (F.col("id") % 17).cast("double").alias("v"))
    whole, cut = (intervals.bootstrap(df.repartition(n), ["g"], F.col("id"), "v", 200, block=b).first() for n, b in ((1, 4096), (5, 16)))
    assert all(abs(whole[c] - cut[c]) < 1e-9 for c in ("n", "mean", "lo", "hi"))


def test_pairs(spark):
    rows = [("e", m, k, float(v)) for m, k, v in [("a", 1, 3), ("a", 2, 5), ("b", 1, 1), ("c", 2, 1), ("b", None, 4)]]
    out = intervals.compared(spark.createDataFrame(rows, "e string, m string, k int, v double"), "e", "m", "k", "v", [("a", "b"), ("a", "c"), ("b", "c")])
    assert sorted(map(tuple, out.collect())) == [("e", 1, "a", "b", 2.0), ("e", 2, "a", "c", 4.0)]
