"""A split built again keeps what is right and writes the rest; a lost build changes nothing; a stream sent twice is there once."""

import pytest
from pyspark.sql import functions as F

from pagemill.sinks import shards
from pagemill.streaming.append import append_once


def states(plan):
    return {r["shard"]: r["kept"] for r in plan.collect()}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def rows(spark):
    return spark.range(40).select("id", (F.col("id") % 4).alias("s"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("note"))


def test_rebuild(spark, tmp_path, rows):
    folder = str(tmp_path)
    names = ["v0", "v1", "v2", "v3"]
    assert states(shards.build_split(rows, folder, "s", "a")) == dict.fromkeys(names, False)
    assert states(shards.build_split(rows, folder, "s", "a")) == dict.fromkeys(names, True)
    # Content changed in one shard, a row doubled in another.
    other = rows.withColumn("note", F.when(F.col("id") == 1, "y").otherwise(F.col("note"))).unionByName(rows.filter("id = 2"))
    assert states(shards.build_split(other, folder, "s", "a")) == {"v0": True, "v1": False, "v2": False, "v3": True}
    assert rows_of(shards.read_split(spark, folder, rows.schema)) == rows_of(other)
    assert rows_of(shards.read_split(spark, folder, rows.schema, F.col("s") == 2)) == rows_of(other.filter("s = 2"))
    # A shard's files are lost.
    for file in tmp_path.glob("data/*/_shard=v3/*"):
        file.unlink()
    assert states(shards.build_split(other, folder, "s", "a")) == {"v0": True, "v1": True, "v2": True, "v3": False}
    assert rows_of(shards.read_split(spark, folder, rows.schema)) == rows_of(other)
    # Other parameters: all is written.
    assert not any(states(shards.build_split(other, folder, "s", "b")).values())
    assert states(shards.build_split(rows.limit(0), folder, "s", "b")) == {}
    assert shards.read_split(spark, folder, rows.schema).count() == 0


def test_null_and_empty_shards(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "null"), (4, "a/b"), (5, None), (6, "v")], "id int, s string")
    folder = str(tmp_path)
    for kept in (False, True):
        assert states(shards.build_split(rows, folder, "s", "a")) == dict.fromkeys(["null", "v", "vnull", "va/b", "vv"], kept)
        assert rows_of(shards.read_split(spark, folder, rows.schema)) == rows_of(rows)


def test_a_lost_build_leaves_the_last_one(spark, tmp_path, rows):
    folder = str(tmp_path)
    shards.build_split(rows, folder, "s", "a")
    new = rows.withColumn("note", F.when(F.col("s") < 2, "new").otherwise(F.col("note")))
    shards.build_split(new, folder, "s", "a")
    (tmp_path / "lists" / "2" / "_SUCCESS").unlink()  # as if it had broken before the list was whole
    assert rows_of(shards.read_split(spark, folder, rows.schema)) == rows_of(rows)
    assert states(shards.build_split(new, folder, "s", "a")) == {"v0": False, "v1": False, "v2": True, "v3": True}
    assert rows_of(shards.read_split(spark, folder, rows.schema)) == rows_of(new)


def test_nothing_built(spark, tmp_path, rows):
    assert shards.read_split(spark, str(tmp_path / "none"), rows.schema).count() == 0


def test_rows_sent_twice(spark, tmp_path):
    sent = [(1, "a"), (None, "b"), (2, None)]
    spark.createDataFrame(sent, "k int, v string").write.parquet(f"{tmp_path}/in")
    target = f"{tmp_path}/out"
    for i in range(2):  # the second checkpoint knows nothing of the first
        append_once(spark.readStream.schema("k int, v string").parquet(f"{tmp_path}/in"), target, ["k"], f"{tmp_path}/checkpoint{i}")
    assert rows_of(spark.read.schema("k int, v string").parquet(target).select("k", "v")) == sorted(sent, key=repr)
    for i in range(2):  # a key of two columns, in a target of its own
        append_once(spark.readStream.schema("k int, v string").parquet(f"{tmp_path}/in"), f"{target}-2", ["k", "v"], f"{tmp_path}/other{i}")
    assert spark.read.parquet(f"{target}-2").count() == 3
