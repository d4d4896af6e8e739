import re

import corpus_pipeline
from glyphmill.llm import language_id


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    phrase = "this exact passage stands in the benchmark and must not be trained on at all"
    texts = [" ".join(f"word{(i * 7 + j * j) % 997}" for j in range(60)) for i in range(40)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0] + " x", "en", "s0", 1), (101, "123 456", "en", "s0", 7), (102, None, "en", "s1", 0), (103, f"{texts[1][:50]} {phrase} {texts[2][:90]}", "en", "s1", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    kept = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], (range(40), range(40), range(40)), strict=True):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        assert set(want) <= {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in kept.collect()} == set(range(40))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert {r.doc_id for r in out.collect()} <= set(range(40))
    taken = sum(len(re.findall(r"\S+", r.text)) for r in out.collect())
    assert abs(taken - 40 * 60) < 600
    assert language_id.AMBIGUOUS > 0
