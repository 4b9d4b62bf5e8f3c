"""Summaries by method, baselines, bootstrap intervals, merges and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the interval: resamples, level and seed.
RESAMPLES, LEVEL, SEED = 10_000, 0.95, 0
#: About so many draws are held at a time: 16 bytes each.
DRAWS = 1 << 20


def method_summary(facts: DataFrame, method: str, key: str, value: str, baseline: str) -> DataFrame:
    """``method, n, mean_value, gain_vs_input``: means, and the mean over keys of the difference to the baseline's mean of the same key."""
    by_key = facts.groupBy(F.col(method).alias("method"), F.col(key).alias("_key")).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    mean = F.col("total") / F.col("n")
    base = by_key.filter(F.col("method") == baseline).select("_key", mean.alias("base"))
    joined = by_key.withColumn("mean", mean).join(base, "_key", "left")
    gain = F.avg(F.when(F.col("method") != baseline, F.col("mean") - F.col("base")))
    return joined.groupBy("method").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_value"), gain.alias("gain_vs_input"))


def interval(values: np.ndarray, resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED) -> tuple[float, float, float]:
    """Mean and percentile interval; as many resamples are drawn at a time as ``DRAWS`` allow, one at least. The draws are the same however they are cut."""
    rng, means, left = np.random.default_rng(seed), [], resamples
    while left:
        some = min(left, max(1, DRAWS // len(values)))
        means.append(values[rng.integers(0, len(values), (some, len(values)))].mean(1))
        left -= some
    tail = 100 * (1 - level) / 2
    lo, hi = np.percentile(np.concatenate(means), [tail, 100 - tail])
    return float(values.mean()), float(lo), float(hi)


def bootstrap_exact(values: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """``group, n, mean, lo, hi`` with numpy's generator, whose draws follow one another, so that a group is one task's work.

    The task holds the group's rows and one resample, or ``DRAWS`` draws: its memory grows with the group alone, not with the number of resamples.
    """

    def run(rows: pa.Table) -> pa.Table:
        v = rows.select([value]).take(pc.sort_indices(rows, [(key, "ascending")])).column(0).to_numpy()
        return pa.table([rows.column(group)[:1], *([x] for x in (len(v), *interval(v)))], names=[group, "n", "mean", "lo", "hi"])

    numbers = values.select(F.col(group).cast("string").alias(group), key, F.col(value).cast("double").alias(value))
    return numbers.groupBy(group).applyInArrow(run, f"{group} string, n bigint, mean double, lo double, hi double")


def newest_wins(results: DataFrame, label: str, job: str, n: str, fields: Sequence[str]) -> DataFrame:
    """One row a label: of the rows with its largest ``n``, each field's last non-null value in job order, and the last job."""
    largest = F.max(n).over(Window.partitionBy(label))
    kept = results.withColumn("_largest", largest).filter(F.col(n) == F.col("_largest"))
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(job))).alias(f) for f in fields]
    return kept.groupBy(label).agg(F.max(n).alias(n), F.max(job).alias(job), *last)


def breakdown(facts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``dimension, level, n, mean``: the mean by each field on its own, in one pass; a missing level is ``?``."""
    levels = [F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("?")).alias("level")) for c in by]
    long = facts.select(F.explode(F.array(*levels)).alias("_d"), F.col(value).alias("_v"))
    return long.groupBy("_d.dimension", "_d.level").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))


def prefix_baselines(rows: DataFrame, label: str, baselines: Sequence[tuple[str, str]]) -> Column:
    """The baseline of the first prefix that a label starts with, or null."""
    out = F.lit(None).cast("string")
    for prefix, name in reversed(baselines):
        out = F.when(F.col(label).startswith(prefix), name).otherwise(out)
    return out


#: A selection counts values in so many buckets, until so few are left as the driver may sort.
SELECT_BUCKETS, SELECT_MOST = 4096, 10_000


def _finite(rows: DataFrame, value: Column) -> DataFrame:
    return rows.select(value.cast("double").alias("v")).filter(~F.isnan("v") & (F.abs("v") < float("inf")))


def nth_value(rows: DataFrame, value: Column, rank: int) -> float | None:
    """The value of a rank (from 0) among all: each pass counts by buckets, and goes on inside the one that holds the rank.

    A pass is one scan with partial counts, whatever the number of distinct values. Values that aren't finite (nulls too)
    take no part; None if the rank is beyond the others.
    """
    rows = _finite(rows, value)
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if rank >= n:
        return None
    while low < high and n > SELECT_MOST:
        width = max(high / SELECT_BUCKETS - low / SELECT_BUCKETS, 5e-324)
        bucket = F.least(F.floor((F.col("v") - low) / width), F.lit(SELECT_BUCKETS - 1))
        counts = rows.filter(F.col("v").between(low, high)).groupBy(bucket.alias("bucket")).agg(F.count("*"), F.min("v"), F.max("v"))
        for _, n, low, high in sorted(counts.collect()):  # SELECT_BUCKETS rows at most
            if rank < n:
                break
            rank -= n
    if low == high:
        return low
    return sorted(r.v for r in rows.filter(F.col("v").between(low, high)).collect())[rank]  # SELECT_MOST rows at most


def exact_median(rows: DataFrame, value: Column) -> float | None:
    """The middle value, or the mean of the two in the middle, of the finite values; None without any."""
    usable = _finite(rows, value)
    n = usable.count()
    if not n:
        return None
    middle = nth_value(usable, F.col("v"), (n - 1) // 2)
    if n % 2:
        return middle
    upto, above = usable.agg(F.count_if(F.col("v") <= middle), F.min(F.when(F.col("v") > middle, F.col("v")))).first()
    return middle if upto > n // 2 else (middle + above) / 2


def outliers(rows: DataFrame, value: str, k: float) -> DataFrame:
    """Rows more than ``k`` robust deviations above the median; the two medians are single numbers."""
    middle = exact_median(rows, F.col(value))
    if middle is None:
        return rows.limit(0)
    spread = exact_median(rows, F.abs(F.col(value) - F.lit(middle)))
    return rows.filter(F.col(value) > F.lit(middle) + k * (1.4826 * F.lit(spread) + 1e-6))
