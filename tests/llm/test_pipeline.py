import corpus_pipeline


def test_stages_filter_and_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns, name
        assert 0.7 * before <= docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(pieces.doc_id) == {r["doc_id"] for r in docs.collect()}


def test_run_equals_its_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).selectExpr("sum(length)").first()[0] > 0
