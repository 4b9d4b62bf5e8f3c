"""Bootstrap intervals of means that merge: each block of a group's rows adds up its own part of every resample.

A resample gives each row a weight, how often it was drawn, Poisson with mean 1. The weight depends on the row's key and on the number of the
resample alone (a counter, not a stream of random numbers), so a group's rows can be dealt out to blocks at will and blocks can be lost and done again: sums of weights and of
weighted values add up to the same resamples. A resample's mean is the one sum by the other.

How it scales: a group is cut into blocks of about ``BLOCK`` rows by hash of the key, each a task's array work; what is shuffled of a block are
two numbers a resample, not a row a draw. No group is in one task, and nothing is sorted but the resamples' means.

Defined results: rows whose value is null or NaN take no part; groups (null is one) without values are absent; equal keys of a group are drawn together;
of one row only, all means are its value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESAMPLES, LEVEL, BLOCK = 10_000, 0.95, 4096
#: Draws are numbers below this prime, made by squaring.
PRIME = 2**31 - 1
#: Below which number a row is drawn not more than 0, 1, 2 ... times.
CUTS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]


def draws(keys: np.ndarray, first: int, last: int) -> np.ndarray:
    """The weights of rows (by whole-number keys) in the resamples from ``first`` up to ``last``, a row of the result each."""
    k, r = keys % PRIME, np.arange(first, last + 1, dtype=np.int64)[:, None]
    x = (k * 69_621 + r * 16_807 + 12_345) % PRIME
    x = (x * x + k) % PRIME
    x = (x * x + r) % PRIME
    x = x * 48_271 % PRIME
    return np.searchsorted(np.array(CUTS), x, side="right").astype(np.float64)


#: The same in SQL, for a key ``k`` (of 0 to ``PRIME`` - 1) and a resample ``r``.
DRAWS_SQL = f"""(SELECT {' + '.join(f'(x >= {c})::INTEGER' for c in CUTS)} FROM (SELECT (x * x + r) % {PRIME} * 48271 % {PRIME} AS x FROM (SELECT (x * x + k) % {PRIME} AS x
  FROM (SELECT (k * 69621 + r * 16807 + 12345) % {PRIME} AS x))))"""


def bootstrap(values: DataFrame, by: Sequence[str], key: Column, value: str, resamples: int = RESAMPLES, level: float = LEVEL, block: int = BLOCK) -> DataFrame:
    """``by..., n, mean, lo, hi``: the mean of each group, and the middle ``level`` of its resamples' means. ``key`` is a whole number of each row."""
    by = list(by)
    rows = values.select(*by, F.pmod(key.cast("bigint"), F.lit(PRIME).cast("bigint")).alias("_k"), F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    sizes = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    dealt = rows.join(sizes, same).withColumn("_block", F.pmod(F.xxhash64("_k"), F.ceil(F.col("n") / block)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*by).schema)

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A block comes in one or more frames; each adds its own rows.
        for part in parts:
            for _, mine in part.groupby([*by, "_block"], dropna=False, sort=False):
                for at in range(0, len(mine), block):
                    some = mine.iloc[at : at + block]
                    v = some["_v"].to_numpy()
                    both = []
                    for first in range(1, resamples + 1, 500):
                        w = draws(some["_k"].to_numpy(), first, min(first + 499, resamples))
                        both.append(np.stack((w.sum(1), w @ v), axis=1))
                    both = np.concatenate(both)
                    out = {c: [some[c].iloc[0]] for c in by} | {"weights": [both[:, 0]], "sums": [both[:, 1]]}
                    yield pd.DataFrame(out)

    parts = dealt.repartition(*by, "_block").sortWithinPartitions(*by, "_block").select(*by, "_block", "_k", "_v").mapInPandas(summed, f"{kinds}, weights array<double>, sums array<double>")
    each = parts.select(*by, F.posexplode(F.arrays_zip("weights", "sums")).alias("_r", "_s"))
    means = each.groupBy(*by, "_r").agg((F.sum("_s.sums") / F.nullif(F.sum("_s.weights"), F.lit(0.0))).alias("_m"))
    tail = (1 - level) / 2
    ends = means.groupBy(*by).agg(F.expr(f"percentile(_m, {tail})").alias("lo"), F.expr(f"percentile(_m, {1 - tail})").alias("hi"))  # ``resamples`` values a group
    return sizes.join(ends, same).select(*by, "n", "mean", "lo", "hi")


def compared(scores: DataFrame, by: str, method: str, key: str, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``by, a, b, key, difference``: for each pair of methods the first's value less the second's, on the keys both have."""
    told = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs)))
    sides = scores.filter(F.col(method).isin(sorted({m for p in pairs for m in p}))).select(by, key, method, value, told.alias("p")).filter(F.col(method).isin(F.col("p.a"), F.col("p.b")))
    pick = lambda side: F.max(F.when(F.col(method) == F.col(f"p.{side}"), F.col(value)))  # noqa: E731  one row a method and key
    both = sides.groupBy(by, key, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg((pick("a") - pick("b")).alias("difference"))
    return both.filter("difference is not null")
