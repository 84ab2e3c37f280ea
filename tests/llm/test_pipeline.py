from collections import Counter

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "packing"]
    before = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.save(stage(spark, docs, sf), "t")
        if i < 4:
            assert out.columns == docs.columns
        if i < 3:
            assert 0 < out.count() <= before
            before = out.count()
        docs = out
    pieces = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in pieces) <= 4096
    assert Counter(docs.columns) == Counter(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
