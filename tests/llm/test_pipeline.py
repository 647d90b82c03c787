import corpus_pipeline as P
from streamloom.llm import jaccard, quality_model, toxicity


def test_stages(spark, sf, tmp_path):
    """Each stage is what its operator decides on the rows that the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        ids, before = [r.doc_id for r in out.select("doc_id").collect()], {r.doc_id for r in docs.select("doc_id").collect()}
        assert set(ids) <= before
        if name == "quality":
            assert set(ids) == {r.doc_id for r in quality_model.classify(docs, labels).where("predicted = 1").collect()}
        if name == "toxicity":
            assert set(ids) == {r.doc_id for r in toxicity.classify(docs, labels).where("predicted = 0").collect()}
        if name == "near_copies":
            assert sorted(ids) == sorted({r.component_id for r in jaccard.link_classes(docs).collect()})
        if name == "tokens":
            assert len(ids) == docs.count() and all(r.n_tokens == len(r.token_ids) for r in out.collect())
        else:
            assert out.columns == columns
        docs = out


def test_null_and_repeated_ids(spark):
    """Copies without an id are left out, other documents of a repeated id stay, and rows without an id get their copies."""
    from conftest import documents

    from streamloom.llm import jaccard, mixing

    long = " ".join(f"w{i}" for i in range(60))
    near = long + " end"
    rows = [(None, long, "en", "a"), (None, long, "en", "a"), (None, near, "en", "a"), (7, "one quite different text of some words", "en", "a"), (7, "and another that is not alike at all", "en", "a"), (7, near, "en", "a"), (9, long, "en", "a")]
    kept = sorted((str(r.doc_id), r.text) for r in jaccard.one_of_each(documents(spark, rows)).collect())
    assert kept == sorted([("7", rows[3][1]), ("7", rows[4][1]), ("7", near)])
    # One source of 40 rows without an id: each 4 words, of two texts; 1.5 times their words are to come out.
    rows = [(None, f"four words in {'all' if i % 2 else 'sum'}", "en", "a") for i in range(40)]
    assert abs(mixing.mixed_documents(documents(spark, rows)).count() - 60) <= 1
    assert abs(mixing.mixed_documents(documents(spark, rows), budget_share=0.4).count() - 16) <= 1
    assert abs(mixing.mixed_documents(documents(spark, rows), budget_share=1.4).count() - 56) <= 1
