"""The registered queries of this package: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import chat, decontam, divergence, fuzzy_lines, hilbert_ann, language_id, main_text, minhash, mixing, periodic_runs, secrets, toxicity, url_filter


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("found", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), "n_entropy")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in url_filter.LISTED_HOSTS], "key string")
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id.identify(language_id.of_documents(docs), ["doc_id"]).withColumn("posterior", F.round("posterior", 6))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return language_id.identify(language_id.of_pages(pages), ["page_id", "declared"]).withColumn("posterior", F.round("posterior", 6))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = fuzzy_lines.without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The conversation that the contract adds: both turns hold control strings.
EXTRA_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return chat.format_conversations(kept.unionByName(spark.createDataFrame(EXTRA_CONVERSATION, schema)))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(told, lambda x: F.concat(x, F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.col2"), F.col("best.length"), -F.col("best.col3")
    milli = F.floor(1000 * length / period).cast("bigint")
    return best.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "language_id_pages": language_id_pages,
    "op4_minhash": op4_minhash,
    "op5_mixing": op5_mixing,
    "op6_hilbert_ann": op6_hilbert_ann,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
    "op11_main_text": op11_main_text,
    "op12_divergence": op12_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}
