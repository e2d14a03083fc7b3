from __future__ import annotations

import corpus_pipeline
from lodestream.llm import decontam, langid
from test_jaccard import slow_first

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    kept = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        if i < 3:
            assert kept[-1].columns == columns
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    assert ids[1] == sorted(r.id for r in langid.predict(docs, langid.train(docs)).where("lang_pred <> 'und'").collect())
    assert ids[2] == slow_first([(r.doc_id, r.text) for r in kept[1].collect()])
    found = decontam.contamination(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids[3] == sorted(r.id for r in found.where("not contaminated").collect())
    assert set(ids[4]) == set(ids[3])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == ids[4]
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_documents_pass(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted({str(r.doc_id) for r in docs.collect()}) == ["1", "7", "8", "9", "None"]
