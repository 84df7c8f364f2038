from pyspark.sql import functions as F

import corpus_pipeline
from deltaloom.llm import similar


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, seen[-1], sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen.append(out.cache())
    _, good, distinct, apart, clean, tokens = seen
    assert good.count() < docs.count() and good.exceptAll(docs).count() == 0
    assert distinct.count() == good.select("text").distinct().count()
    best = good.groupBy("text").agg(F.max("doc_id").alias("doc_id")).select("doc_id")
    assert best.exceptAll(distinct.select("doc_id")).count() == 0
    near = similar.near_duplicates(distinct, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_SIMILARITY)
    assert apart.count() == near.select("component").distinct().count()
    assert clean.count() <= apart.count() and tokens.count() == clean.count()
    assert tokens.filter("size(ids) = 0").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "ids"]


def test_empty_and_null_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    nulls = spark.createDataFrame([(None,) * 5, (None,) * 5], docs.schema)
    for start in (docs.filter(F.lit(False)), nulls):
        now = start
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            now = f(spark, now, sf)
            now.write.parquet(f"file://{tmp_path}/{start.count()}-{k}")
            now = spark.read.parquet(f"file://{tmp_path}/{start.count()}-{k}")
        assert now.count() <= 1
