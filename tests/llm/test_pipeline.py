"""The corpus pipeline over a small table, stage by stage."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqpick.llm.common import stage_table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_chain(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage_table(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert n > seen[0] > seen[1] > seen[2] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == seen[-1]
    assert last.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n") - F.min("n")).first()[0] <= 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_copies_go_and_their_first_stays(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()}
    first = {r[0] for r in docs.groupBy("text").agg(F.min("doc_id")).select(F.col("min(doc_id)")).collect()}
    assert kept <= first


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
