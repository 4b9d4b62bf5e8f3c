"""A split built shard by shard, again and again: what is there and right stays, what is missing or wrong is written.

``data`` holds rows by build and shard, ``lists`` one list of shards a build, each naming the build that wrote it. Nothing is ever written
over: a build adds its own rows, then its list, and only a list that Spark has marked as whole counts. So a build that is lost on the way leaves the last
one as it was, and the next build keeps what is right of that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tagged(shard: str) -> Column:
    """A shard's value as the name of a folder: nulls and empty strings have names too."""
    return F.coalesce(F.concat(F.lit("v"), F.col(f"`{shard}`").cast("string")), F.lit("null"))


def _sums(rows: DataFrame, shard: str) -> DataFrame:
    """``shard, n, digest`` of each shard; the digest doesn't depend on the order of rows, and equal rows count each."""
    row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns) if c != shard)), {"ignoreNullFields": "false"}))
    return rows.groupBy(tagged(shard).alias("shard")).agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("digest"))


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder; none if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []


def last_build(spark: SparkSession, folder: str) -> int:
    """The number of the last build whose list is whole; 0 if there is none."""
    whole = [int(x) for x in _names(spark, f"{folder}/lists") if x.isdigit() and "_SUCCESS" in _names(spark, f"{folder}/lists/{x}")]
    return max(whole, default=0)


def _listed(spark: SparkSession, folder: str, schema, listed: DataFrame) -> DataFrame:
    """The rows that the list names, with their ``_shard``; folders it doesn't name are not read."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = spark.read.schema(f"{kinds}, _build string, _shard string").parquet(f"{folder}/data")
    named = F.broadcast(listed.select(F.col("build").alias("_b"), F.col("shard").alias("_s")))  # a row a shard
    return rows.join(named, (F.col("_build") == F.col("_b")) & (F.col("_shard") == F.col("_s")), "left_semi")


def build_split(rows: DataFrame, folder: str, shard: str, params: str) -> DataFrame:
    """Bring ``folder`` to hold ``rows``, a folder for each value of ``shard`` (null is one); returns ``shard, n, digest, kept`` of the plan.

    A shard is kept if the last whole build had the same parameters and the rows it holds now are those of the plan; all others are
    written, each in whole. ``shard`` in the result is ``v`` and the value, or ``null``. Shards that the plan doesn't name are no longer listed. One writer at a time.
    """
    spark = rows.sparkSession
    plan, number, build = _sums(rows, shard), last_build(spark, folder), uuid.uuid4().hex
    held = spark.createDataFrame([], "shard string, n bigint, digest decimal(38,0), build string")
    if number:
        listed = spark.read.parquet(f"{folder}/lists/{number}").filter(F.col("params") == params)
        if not listed.isEmpty() and _names(spark, f"{folder}/data"):
            held = _sums(_listed(spark, folder, rows.schema, listed).select(*(f"`{c}`" for c in rows.columns)), shard).join(listed.select("shard", "build"), "shard")
    plan = plan.join(held, ["shard", "n", "digest"], "left").select("shard", "n", "digest", F.coalesce("build", F.lit(build)).alias("build"))
    # The plan is written down: what it keeps must not change while rows are written.
    plan.withColumn("params", F.lit(params)).write.mode("overwrite").parquet(f"{folder}/plan")
    plan = spark.read.parquet(f"{folder}/plan")
    todo = plan.filter(F.col("build") == build).select(F.col("shard").alias("_todo"))
    missing = rows.withColumn("_build", F.lit(build)).withColumn("_shard", tagged(shard)).join(F.broadcast(todo), F.col("_shard") == F.col("_todo"), "left_semi")
    missing.write.mode("append").partitionBy("_build", "_shard").parquet(f"{folder}/data")
    plan.write.mode("overwrite").parquet(f"{folder}/lists/{number + 1}")
    return plan.select("shard", "n", "digest", (F.col("build") != build).alias("kept"))


def read_split(spark: SparkSession, folder: str, schema, only: Column | None = None) -> DataFrame:
    """The rows of the shards that the last whole build lists; none if no build is whole."""
    number = last_build(spark, folder)
    if not number:
        return spark.createDataFrame([], schema)
    rows = _listed(spark, folder, schema, spark.read.parquet(f"{folder}/lists/{number}")).select(*(f"`{f.name}`" for f in schema))
    return rows if only is None else rows.filter(only)
