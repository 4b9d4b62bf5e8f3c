"""A training corpus from raw documents, in five stages; each is written as Parquet and read again by the next.

Language identification drops what is in no language; line dedup cuts lines that occur elsewhere; MinHash keeps one
document of each group of near copies; decontamination drops documents with benchmark passages; mixing gives
the rest positions in training, by source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontam, fuzzy_lines, language_id, minhash, mixing
from pagemill.llm.shared import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.kept_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur elsewhere; those that have lost all their text go."""
    clean = fuzzy_lines.without_repeated_lines(docs)
    return clean.filter("n_removed = 0 OR trim(text) != ''").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language identification", identify_language),
    ("line dedup", dedup_lines),
    ("near-copy removal", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Edit similarity, character n-gram models and MinHash candidates aren't SQL. Tests hold the run against its stages called one by one, and each stage against brute force on fixtures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``<sf_dir>/documents.parquet``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pagemill/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
