"""Pairs, splits, shards and resumption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.keys import stable_seed


def paired(left: DataFrame, right: DataFrame, on: Sequence[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Full outer pairs by key with ``problem``: null for a pair, else which side has no partner."""
    a, b = left.withColumn("_a", F.lit(True)), right.withColumn("_b", F.lit(True))
    problem = F.when(F.col("_b").isNull(), f"no {names[1]}").when(F.col("_a").isNull(), f"no {names[0]}")
    return a.join(b, list(on), "full").withColumn("problem", problem).drop("_a", "_b")


def held_out(keys: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """The ``n`` keys of smallest seed; the remainder is an anti-join with it."""
    return keys.orderBy(stable_seed(salt, F.col(key)), key).limit(n)


def ranked(rows: DataFrame, bucket: Column, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based rank over all rows in the order of ``bucket`` (a coarse, monotone part of the order), then ``order``.

    Sizes of the buckets are added up first, so no task sorts more than one bucket.
    """
    cut = rows.withColumn("_bucket", bucket)
    sizes = cut.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return cut.withColumn("_in", inside).join(base, "_bucket").withColumn(name, (F.col("_base") + F.col("_in")).cast("bigint")).drop("_bucket", "_in", "_base")


def shares_split(keys: DataFrame, key: str, salt: str, shares: Sequence[tuple[str, float]], rest: str) -> DataFrame:
    """``split`` by rank along the seeds: each named share is rounded half to even, the remainder is ``rest``."""
    n = keys.count()
    seeded = keys.withColumn("_seed", stable_seed(salt, F.col(key)))
    placed = ranked(seeded, F.shiftright("_seed", 50), [F.col("_seed"), F.col(key)])
    cuts, at = F.lit(rest), 0
    for name, share in shares:
        begin, at = at, at + round(n * share)
        cuts = F.when((F.col("rank") > begin) & (F.col("rank") <= at), name).otherwise(cuts)
    return placed.withColumn("split", cuts).drop("_seed", "rank")


def shard_plan(keys: DataFrame, key: str, size: int) -> DataFrame:
    """``shard`` numbers for runs of ``size`` rows along a numeric key. Spans of the key's range are ranked apart."""
    low, high = keys.agg(F.min(key), F.max(key)).first()
    span = max(1, ((high or 0) - (low or 0) + 1) // 1024)
    return ranked(keys, F.floor((F.col(key) - (low or 0)) / span), [F.col(key)]).withColumn("shard", F.floor((F.col("rank") - 1) / size).cast("bigint")).drop("rank")


def manifest(members: DataFrame, key: str, size: Column) -> DataFrame:
    """One row a shard: its samples, bytes and sorted sources. A shard's size bounds its list."""
    return members.groupBy("shard").agg(F.count("*").alias("samples"), F.sum(size).cast("bigint").alias("bytes"), F.sort_array(F.collect_list(key)).alias("sources"))


def unfinished(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned shards that are absent from the manifest or have other sources there."""
    return plan.join(done.select("shard", "sources"), ["shard", "sources"], "left_anti")


def pending(plan: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Planned work that isn't recorded yet."""
    return plan.join(done.select(*key).distinct(), list(key), "left_anti")


def packed(files: DataFrame, size: str, order: Sequence[str], most: int) -> DataFrame:
    """Smallest files first while the total stays within ``most``.

    Only files below the size at which the total is certainly spent need an order: sums by size class
    find that class, so the running sum sees the files of small classes alone.
    """
    classes = files.groupBy(F.floor(F.log2(F.greatest(F.col(size), F.lit(1)))).alias("class")).agg(F.sum(size).alias("sum"))
    before = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    last = classes.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).filter(F.col("before") <= most).agg(F.max("class")).first()[0]
    fit = files.filter(F.floor(F.log2(F.greatest(F.col(size), F.lit(1)))) <= (last if last is not None else -1)).filter(F.col(size) <= most)
    running = F.sum(size).over(Window.orderBy(*[F.col(c) for c in (size, *order)]).rowsBetween(Window.unboundedPreceding, 0))
    return fit.withColumn("total", running).filter(F.col("total") <= most)
