"""Session factory with the settings every query here assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "pagemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI mode and adaptive execution on.

    ``master`` is set only where the launcher (spark-submit, a notebook) has not chosen one.
    Extra settings go in with underscores for dots: ``spark_sql_shuffle_partitions="64"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    n = cpus or os.cpu_count() or 2
    return build_session(
        master=f"local[{n}]",
        **{
            "spark_sql_shuffle_partitions": str(n),
            "spark_driver_memory": "8g",
            "spark_ui_enabled": "false",
        }
        | conf,
    )
