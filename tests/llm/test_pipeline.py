import corpus_pipeline
from millrace.llm import decontaminate, packing, pii, quality


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "quality_classifier":
            assert all(labels.get(d, 1) == 1 for d in ids) and all(d in ids for d, x in labels.items() if x == 1)
        elif name == "simhash_near_dedup":
            assert after.select("text").distinct().count() == after.count() == len(ids)
        elif name == "benchmark_decontamination":
            assert not any(b in r.text for r in after.collect() for b in bench)
            lost = before.join(after.select("doc_id"), "doc_id", "left_anti").collect()
            assert all(decontaminate.Index(list(enumerate(bench))).best(r.text)[0] >= decontaminate.THRESHOLD for r in lost)
        else:
            assert len(ids) == before.count()
            assert all(r.n_chars == len(r.text) for r in after.collect())
        before = after
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in before.collect()}
    assert sum(r.n_tokens for r in got) == sum(1 + len(r.text.split()) for r in before.collect())


def test_empty_documents(spark, sf):
    before = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, sf)
    assert before.collect() == []
