"""Registered queries on jobs' events, and a stream of samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemill.operators import lifecycle
from pagemill.plans.catalog import query, work_folder
from pagemill.sources.tables import table
from pagemill.streaming import positions

_STATES = "CASE event_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' ELSE 'running' END"


def events(spark, d):
    kind = F.col("event_id") % 5
    state = F.when(kind == 0, "done").when(kind == 1, "failed").when(kind == 2, "partial").otherwise("running")
    return table(spark, d, "events").select(F.col("user_id").cast("bigint").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("nr"), state.alias("state"), (F.col("event_id") % 3).alias("attempt"))


@query(f"""WITH e AS (SELECT user_id AS job, ts AS t, event_id AS nr, {_STATES} AS state, event_id % 3 AS attempt FROM events),
s AS (SELECT job, arg_max(state, (t, nr)) AS state, arg_max(attempt, (t, nr)) AS attempt, count(*) FILTER (WHERE state = 'running') AS n_starts,
  max(t) FILTER (WHERE state = 'done') AS done, max(t) FILTER (WHERE state = 'running') AS started FROM e GROUP BY job),
j AS (SELECT *, job % 3 AS asked, job % 2 = 0 AS resume FROM s UNION ALL SELECT max(user_id) + 1, NULL, NULL, 0, NULL, NULL, 0, true FROM events)
SELECT j.job, j.state, coalesce(j.n_starts, 0) AS n_starts, coalesce(started IS NULL AND done IS NOT NULL OR started <= done, false) AS has_result,
  NOT (coalesce(j.state = 'done' OR j.state = 'failed' AND j.attempt = j.asked, false) OR (j.job % 4 = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.job = j.job - 1 AND s.state = 'done'))) AS may_start,
  coalesce(j.resume AND j.state IN ('running', 'partial'), false) AS keeps FROM j""")
def job_decisions(spark, d):
    """The state of every job by its events, sent twice, and whether it may start: each fourth needs the one before it; one job is unknown."""
    log = events(spark, d)
    now = lifecycle.states(log.unionByName(log))
    jobs = log.select("job").distinct().union(log.select(F.max("job") + 1))
    asked = jobs.select("job", F.when(F.col("job") % 1 == 0, F.col("job") % 3).alias("attempt"), (F.col("job") % 2 == 0).alias("resume"))
    most = log.agg(F.max("job").alias("most"))
    asked = asked.join(F.broadcast(most)).withColumn("resume", F.col("resume") | (F.col("job") > F.col("most"))).drop("most")  # one row
    needs = jobs.filter("job % 4 = 1").select("job", (F.col("job") - 1).alias("needed"))
    out = lifecycle.decisions(asked, now, needs).join(now.select("job", "n_starts", "result_at"), "job", "left")
    done = F.col("result_at").isNotNull()
    has = F.when(F.col("n_starts").isNull(), False).otherwise(done)
    return out.select("job", "state", F.coalesce("n_starts", F.lit(0)).alias("n_starts"), has.alias("has_result"), "may_start", "keeps")


@query(f"""WITH e AS (SELECT user_id AS job, ts AS t, event_id AS nr, {_STATES} AS state FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY t, nr) - row_number() OVER (PARTITION BY job, state ORDER BY t, nr) AS island FROM e),
r AS (SELECT job, state, island, count(*) AS n, min(t) AS since, max(t) AS until, min(nr) AS nr FROM n GROUP BY ALL)
SELECT job, state, n, since, until, row_number() OVER (PARTITION BY job ORDER BY since, nr) - 1 AS spell FROM r""")
def state_spells(spark, d):
    """Runs of events of one state, by a table function over each job's events in order."""
    return lifecycle.spells(events(spark, d))


@query("""SELECT user_id, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS half_width FROM events GROUP BY ALL""")
def mean_half_widths(spark, d):
    """A user's events of a type: their mean and its interval, by an aggregate of our own."""
    groups = table(spark, d, "events").groupBy("user_id", "event_type")
    widths = groups.agg(lifecycle.half_width("value").alias("half_width"))
    return groups.agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean")).join(widths, ["user_id", "event_type"]).withColumn("half_width", F.round("half_width", 6))


@query(f"""WITH c AS (SELECT count(*) AS n FROM documents), p AS (SELECT pos, n, ((pos * 69621 + 7 * 16807 + 12345) % {positions.PRIME}) AS x FROM c, range(0, 2 * (SELECT n FROM c)) t(pos)),
q AS (SELECT n, ((x * x + pos) % {positions.PRIME}) AS x FROM p), s AS (SELECT n, (x * x + 7) % {positions.PRIME} * 48271 % {positions.PRIME} AS draw FROM q)
SELECT draw % n AS place, count(*) AS times FROM s GROUP BY 1""")
def sampled_stream(spark, d):
    """Twice as many samples as documents, by position, in two runs of which the second goes on where the first has ended: how often each place is drawn."""
    n = table(spark, d, "documents").count()
    folder = f"{work_folder(spark)}/positions-{uuid.uuid4().hex}"
    for end in (n // 2, 2 * n):
        stream = positions.positions(spark, 7, end, 5_000).withColumn("place", F.col("draw") % n)
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("place").agg(F.count("*").alias("times"))
