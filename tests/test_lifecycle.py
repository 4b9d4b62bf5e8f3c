"""Jobs' states and decisions by a truth table, spells, and a stream that goes on where it has stopped."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.operators import lifecycle
from pagemill.streaming import positions

T = datetime(2024, 1, 1)
KIND = "job string, at timestamp, nr int, state string, attempt int"


def at(i):
    return T + timedelta(minutes=i)


def test_truth_table(spark):
    """Every state at the same and at another attempt, with and without resuming, with needs met, open and unknown."""
    log = [(f"{s}{a}", at(1), 0, s, a) for s in ("running", "partial", "done", "failed") for a in (1, 2)] + [("base", at(0), 0, "done", 1), ("open", at(0), 0, "failed", 1)]
    now = lifecycle.states(spark.createDataFrame(log, KIND))
    jobs = [(j, 1, r) for j in sorted({x[0] for x in log} | {"new"}) for r in (True,)]
    needs = spark.createDataFrame([("running1", "base"), ("partial1", "open"), ("failed2", "nowhere")], "job string, needed string")
    got = {r["job"]: (r["state"], r["may_start"], r["keeps"]) for r in lifecycle.decisions(spark.createDataFrame(jobs, "job string, attempt int, resume boolean"), now, needs).collect()}
    assert got == {
        "running1": ("running", True, True), "running2": ("running", True, True), "partial1": ("partial", False, True), "partial2": ("partial", True, True), "done1": ("done", False, False),
        "done2": ("done", False, False), "failed1": ("failed", False, False), "failed2": ("failed", False, False), "base": ("done", False, False), "open": ("failed", False, False), "new": (None, True, False),
    }
    fresh = lifecycle.decisions(spark.createDataFrame([("running1", 1, False), ("failed2", 1, False)], "job string, attempt int, resume boolean"), now, needs.limit(0)).collect()
    assert sorted((r["job"], r["may_start"], r["keeps"]) for r in fresh) == [("failed2", True, False), ("running1", True, False)]


def test_a_later_start_hides_results(spark):
    log = [("a", at(1), 0, "running", 1), ("a", at(2), 0, "done", 1), ("b", at(1), 0, "running", 1), ("b", at(2), 0, "done", 1), ("b", at(3), 0, "running", 2), ("c", None, 0, "done", 1), (None, at(1), 0, "done", 1)]
    got = {r["job"]: (r["state"], r["n_starts"], r["result_at"]) for r in lifecycle.states(spark.createDataFrame(log + log[::-1], KIND)).collect()}
    assert got == {"a": ("done", 1, at(2)), "b": ("running", 2, None)}


def test_spells(spark):
    rows = [(1, at(3), 0, "x"), (1, at(1), 0, "x"), (1, at(2), 1, "y"), (1, at(2), 0, "x"), (2, at(0), 0, None), (2, at(1), 0, None)]
    got = lifecycle.spells(spark.createDataFrame(rows, "job bigint, at timestamp, nr int, state string")).orderBy("job", "spell").collect()
    assert list(map(tuple, got)) == [(1, 0, "x", 2, at(1), at(2)), (1, 1, "y", 1, at(2), at(2)), (1, 2, "x", 1, at(3), at(3)), (2, 0, None, 2, at(0), at(1))]


def test_half_width(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0)], "g string, v double")
    assert {r["g"]: r["w"] for r in df.groupBy("g").agg(lifecycle.half_width("v").alias("w")).collect()} == {"a": pytest.approx(1.96), "b": None}


def test_a_continued_stream_is_one_stream(spark, tmp_path):
    def run(name, ends):
        for end in ends:
            stream = positions.positions(spark, 3, end, 7).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-at")
            stream.trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}").collect()))

    whole = run("one", [50])
    assert run("three", [20, 20, 50]) == whole == [(i, positions.draw(3, i)) for i in range(50)]
    spread = spark.createDataFrame([(positions.draw(5, i),) for i in range(20_000)], "d bigint").agg(F.avg("d"), F.countDistinct("d")).first()
    assert abs(spread[0] / positions.PRIME - 0.5) < 0.01 and spread[1] > 19_900
