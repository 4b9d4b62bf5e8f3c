"""Exactly-once append on a primary key, as a bounded stream that a later run continues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.files import exists

#: The target is dealt into so many folders by hash of the key, and a batch reads only those its own keys are in.
BUCKETS = 64


def append_once(stream: DataFrame, target: str, key: Sequence[str], checkpoint: str, buckets: int = BUCKETS) -> None:
    """Append what ``target`` (Parquet) doesn't have by ``key`` (nulls equal each other) yet, until the source is exhausted.

    A batch that is replayed after a failure finds its rows there and adds nothing. Of rows of a batch with equal keys one is kept, any of them.
    A target has one key for good. It has a column ``_bucket`` besides those of the stream, the number of its folder.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(key)).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        if exists(spark, target):
            asked = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most ``buckets``
            held = spark.read.schema(fresh.schema).parquet(target).filter(F.col("_bucket").isin(asked))
            held = held.select("_bucket", *(F.col(k).alias(f"_held{i}") for i, k in enumerate(key))).withColumnRenamed("_bucket", "_held")
            same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_held{i}")) for i, k in enumerate(key)), F.col("_bucket") == F.col("_held"))
            fresh = fresh.join(held, same, "left_anti")
        fresh.write.mode("append").partitionBy("_bucket").parquet(target)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
