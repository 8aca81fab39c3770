"""The pipeline's stages on edge cases and planted copies."""

from brute import edge_documents, edge_labels
from pyspark.sql import functions as F

import corpus_pipeline
from stocktide.session import stage_table

SF = "/root/testdata/sf0.001"


def test_stages_on_edge_cases(spark, tmp_path):
    edge_labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = edge_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        out = stage_table(stage(spark, docs, str(tmp_path)), name)
        assert name == "packing" or out.columns == docs.columns
        docs = out if name != "quality_rules" else docs
    assert docs.count() > 0


def test_run_keeps_one_of_each_copy(spark):
    pieces = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert pieces.join(docs, "doc_id", "left_anti").count() == 0
    twins = docs.groupBy("text").agg(F.collect_set("doc_id").alias("ids")).filter("size(ids) > 1").collect()
    left = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert left and all(len(left & set(t.ids)) <= 1 for t in twins)
