"""The pipeline's stages on the smallest tables against plain versions of each stage's rule."""

import brute

import corpus_pipeline


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs, d).collect()}
    assert not any(brute.quality_base(rows[i])[-1] for i in left)
    some = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    one = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup_stage(spark, some, d).collect()}
    want = {x[0] for x in brute.near_duplicates(list(left.items()), 5, 80) if x[3]}
    assert set(one) == want
    clean = {i for i, t in one.items() if not brute.contamination(t, items)[-1]}
    some = spark.createDataFrame(list(one.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.decontamination(spark, some, d).collect()} == clean
    out = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in out} == clean and all(r["round_trip"] for r in out)
    assert all(sum(brute.pii_base(r["text"])[:4]) == 0 for r in out)
