import corpus_pipeline
from duesight.llm.queries import ORACLE, QUERIES, tokenizer_path


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
            docs = corpus_pipeline.materialise(docs, "test-stage")
            assert 0.5 * n < docs.count() <= n, name
            n = docs.count()
    assert docs.select("doc_id").distinct().count() == n
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_odd_documents_pass_every_stage(spark, sf_dir, odd, empty):
    for docs in (odd, empty):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), "test-stage")
            assert docs.columns == columns
        corpus_pipeline.pack(spark, docs, sf_dir).collect()


def test_every_dealt_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert tokenizer_path().endswith(".json")
