"""Jobs by their events: what state each is in, whether it may start, and what a start does with what is there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The states of a job. A run that is lost stays ``running`` and may start again, as may one that has stopped in the middle.
RUNNING, PARTIAL, DONE, FAILED = "running", "partial", "done", "failed"


def states(events: DataFrame) -> DataFrame:
    """``job, state, attempt, since, n_starts, result_at`` of events ``job, at, nr, state, attempt``: the newest by time (then by number) holds.

    ``result_at`` is when the job was last done, unless it was started again since. Events without a job, a time or a state count nothing; of events with the same
    time and number the greatest state holds. Events may come twice and in any order, so a log that lost runs have left is as good as any.
    """
    told = events.filter("job is not null and at is not null and state is not null").dropDuplicates(["job", "at", "nr", "state", "attempt"])
    last = F.max(F.struct("at", "nr", "state", "attempt")).alias("last")
    done, started = F.max(F.when(F.col("state") == DONE, F.col("at"))), F.max(F.when(F.col("state") == RUNNING, F.col("at")))
    out = told.groupBy("job").agg(last, F.count_if(F.col("state") == RUNNING).alias("n_starts"), done.alias("done"), started.alias("started"))
    result = F.when(F.col("started").isNull() | (F.col("started") <= F.col("done")), F.col("done"))
    return out.select("job", "last.state", "last.attempt", F.col("last.at").alias("since"), "n_starts", result.alias("result_at"))


def decisions(jobs: DataFrame, now: DataFrame, needs: DataFrame) -> DataFrame:
    """``job, state, may_start, keeps`` for each of ``jobs`` (``job, attempt, resume``), by ``now`` (as of :func:`states`) and ``needs`` (``job, needed``).

    A job starts unless it is done, has failed at this very attempt, or needs a job that isn't done (or isn't known). A start keeps earlier results only if the job resumes
    and was running or stopped in the middle. An unknown job has the state null.
    """
    open_ = needs.join(now.filter(F.col("state") == DONE).select(F.col("job").alias("needed")), "needed", "left_anti").select("job").distinct().withColumn("waits", F.lit(True))
    held = jobs.join(now.select("job", "state", F.col("attempt").alias("last_attempt")), "job", "left").join(open_, "job", "left")
    over = F.coalesce((F.col("state") == DONE) | (F.col("state") == FAILED) & (F.col("last_attempt") == F.col("attempt")), F.lit(False))
    keeps = F.coalesce(F.col("resume") & F.col("state").isin(RUNNING, PARTIAL), F.lit(False))
    return held.select("job", "state", (~over & ~F.coalesce("waits", F.lit(False))).alias("may_start"), keeps.alias("keeps"))


@F.udtf(returnType="job bigint, spell bigint, state string, n bigint, since timestamp, until timestamp")
class Spells:
    """Runs of events of one state, for ``TABLE(...) PARTITION BY job ORDER BY (at, nr)`` with columns ``job, at, nr, state``; it holds one event at a time."""

    def __init__(self):
        self.now = None

    def eval(self, row):
        if self.now and self.now[2] == row["state"]:
            self.now[3] += 1
            self.now[5] = row["at"]
            return
        if self.now:
            yield tuple(self.now)
        self.now = [row["job"], self.now[1] + 1 if self.now else 0, row["state"], 1, row["at"], row["at"]]

    def terminate(self):
        if self.now:
            yield tuple(self.now)


def spells(events: DataFrame) -> DataFrame:
    """``job, spell, state, n, since, until``: each job's runs of equal states, in order."""
    spark = events.sparkSession
    spark.udtf.register("pagemill_spells", Spells)
    return spark.sql("SELECT * FROM pagemill_spells(TABLE(SELECT job, at, nr, state FROM {events}) PARTITION BY job ORDER BY (at, nr))", events=events)


@F.pandas_udf(DoubleType())
def half_width(values: pd.Series) -> float:
    """Half the width of the normal 95 % interval of a group's mean; null for less than two values. A group is held by one task: for groups of bounded size."""
    v = values.dropna()
    return float(1.96 * v.std() / len(v) ** 0.5) if len(v) > 1 else None
