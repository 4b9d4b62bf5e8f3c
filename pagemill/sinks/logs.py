"""Appending logs: rows once by key, and logs cut back to a checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.files import csv_rows, exists


def append_rows(rows: DataFrame, path: str, columns: Sequence[str], key: Sequence[str]) -> None:
    """Append the rows whose key (nulls equal each other) isn't there yet to a CSV log with a header; columns it doesn't have are left out."""
    spark = rows.sparkSession
    kept = rows.select(*(F.col(c).cast("string").alias(c) for c in columns)).dropDuplicates(list(key))
    if exists(spark, path):
        there = csv_rows(spark, path, columns).select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(key)))
        same = F.lit(True)
        for i, k in enumerate(key):
            same = same & F.when(F.col(k) != "", F.col(k)).eqNullSafe(F.col(f"_{i}"))
        kept = kept.join(there, same, "left_anti")
    kept.write.mode("append").csv(path, header=True)


def cut_log(log: DataFrame, step: str, last: int, folder: str) -> DataFrame:
    """The log up to step ``last``, written to a new place in ``folder`` before anything reads it, so that a lost run leaves the old one whole."""
    path = f"{folder}/log-{uuid.uuid4().hex}"
    log.filter(F.col(step).cast("bigint") <= last).write.parquet(path)
    return log.sparkSession.read.parquet(path)
