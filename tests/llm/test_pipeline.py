"""The pipeline's stages take effect, each on what the one before kept."""

import corpus_pipeline
from pagemill.llm import decontam


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r["doc_id"] for r in docs.collect()})
        if i < 4:
            assert docs.columns == columns
        if i == 3:
            clean = spark.read.parquet(f"{tmp_path}/{i}")
            assert decontam.find_passages(clean, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] == seen[-2] and len(seen[-1]) > 100
    assert docs.count() == corpus_pipeline.run(spark, folder).count()
