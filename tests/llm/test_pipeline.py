import corpus_pipeline as cp
from ravelin.llm import mixture, simhash, wavelet
from tests.llm.helpers import documents
from tests.llm.test_quality import corpus


def test_stages_and_run(spark, tmp_path):
    texts, labels = corpus(120)
    item = "A question about w1 w2 w3 and rare things of some length. The answer is forty two."
    texts = [*texts, texts[1], texts[2] + " extra", f"{texts[4]} {item}", None]
    docs = documents(spark, texts, [f"s{i % 4}" for i in range(len(texts))])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "near_copies", "decontamination", "mixture", "tokens"]
    left = docs
    for _, stage in cp.STAGES[:-1]:
        new = stage(spark, left, str(tmp_path)).cache()
        assert new.columns == docs.columns
        left = new
    ids = [r["doc_id"] for r in left.collect()]
    good = {i for i, y, _ in labels if y}
    assert 120 not in ids and 122 not in ids
    assert len(good - set(ids)) < 0.4 * len(good)
    out = cp.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(ids)
    size = sum(r["n_tokens"] for r in out)
    assert {r["start"] for r in out} <= set(range(size)) and max(r["start"] + r["n_tokens"] for r in out) == size
    assert mixture and simhash and wavelet
