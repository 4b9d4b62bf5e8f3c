"""Job queues: dependencies, selection, validation, states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def job_states(jobs: DataFrame, edges: DataFrame, status: DataFrame) -> DataFrame:
    """``id, state, n_waiting``: done, failed (at this attempt), waiting for what isn't done, or runnable.

    ``jobs`` has ``id, attempt``; ``edges`` has ``id, needs``; ``status`` has ``id, status, at_attempt``.
    """
    undone = edges.join(status.filter("status = 'done'").select(F.col("id").alias("needs")), "needs", "left_anti")
    waiting = undone.groupBy("id").agg(F.count("*").alias("n_waiting"))
    known = jobs.join(status, "id", "left").join(waiting, "id", "left")
    state = (
        F.when(F.col("status") == "done", "done")
        .when((F.col("status") == "failed") & (F.col("at_attempt") == F.col("attempt")), "failed")
        .when(F.col("n_waiting") > 0, "waiting")
        .otherwise("runnable")
    )
    return known.select("id", state.alias("state"), F.coalesce("n_waiting", F.lit(0)).alias("n_waiting"))


def violations(checks: Sequence[tuple[str, Column]]) -> Column:
    """Messages of the checks that hold, in their order."""
    return F.array_compact(F.array(*(F.when(bad, message) for message, bad in checks)))


def job_reasons(jobs: DataFrame, edges: DataFrame, status: DataFrame, files: DataFrame, session: str) -> DataFrame:
    """``id, runtime, reasons``: why a job can't start in a session of this runtime; no reasons if it can.

    ``jobs`` has ``id, attempt, runtime, file``; ``files`` has the ``file`` that are there; the others are as in :func:`job_states`. A session
    on ``gpu`` takes no job for another runtime.
    """
    done = status.filter("status = 'done'").select(F.col("id").alias("needs"), F.lit(True).alias("is_done"))
    known = jobs.select(F.col("id").alias("needs"), F.lit(True).alias("is_known"))
    counts = edges.join(known, "needs", "left").join(done, "needs", "left").groupBy("id").agg(
        F.count_if(F.col("is_known").isNull()).alias("n_unknown"), F.count_if(F.col("is_known") & F.col("is_done").isNull()).alias("n_waiting"),
    )
    rows = jobs.join(status, "id", "left").join(counts, "id", "left").join(files.select("file", F.lit(True).alias("is_there")), "file", "left")
    reasons = violations([
        ("done", F.col("status") == "done"), ("failed at this attempt", (F.col("status") == "failed") & (F.col("at_attempt") == F.col("attempt"))),
        ("needs unknown jobs", F.col("n_unknown") > 0), ("waits for jobs", F.col("n_waiting") > 0),
        ("file is missing", F.col("file").isNotNull() & F.col("is_there").isNull()), ("needs another runtime", (F.col("runtime") != session) & F.lit(session == "gpu")),
    ])
    return rows.select("id", "runtime", reasons.alias("reasons"))
