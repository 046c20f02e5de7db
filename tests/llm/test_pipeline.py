"""The pipeline on the small tables, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from tallysieve.llm import queries


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids, name
        ids = now
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == ids
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    base = {r["doc_id"] for r in queries.op7_quality_rules(spark, sf).where("not base_failed").collect()}
    found = queries.near.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    single = {r["id"] for r in found.collect() if r["kept"]}
    assert len(clean & base & single - ids) <= 0.03 * len(clean & base & single)
