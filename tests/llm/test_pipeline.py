"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import re
from collections import Counter

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).selectExpr("100000L as doc_id", "'1234 5678 !!' as text", "lang", "source", "n_chars").union(docs.limit(2).selectExpr("doc_id + 100001 as doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.union(extra)
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(f"{tmp_path}/{i}-{name}")
        docs = spark.read.parquet(f"{tmp_path}/{i}-{name}")
        before, docs = docs, stage(spark, docs, SF)
        rows = docs.collect()
        kept.append((before.collect(), rows))
        if i < 4:
            assert docs.columns == before.columns
    (_, language), (_, exact), (_, near), (_, mixed), (_, coded) = kept
    assert {r.doc_id for r in kept[0][0]} - {r.doc_id for r in language} == {100000}
    texts = Counter(r.text for r in language)
    assert len(exact) == len(texts) and {r.text for r in exact} == set(texts)
    best = {}
    for r in language:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in exact} == set(best.values())
    assert {r.doc_id for r in near} <= {r.doc_id for r in exact}
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rs)
    assert abs(words(mixed) - 1.5 * words(near)) < 0.02 * words(near)
    assert max(Counter(r.doc_id for r in mixed).values()) == 2
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0
