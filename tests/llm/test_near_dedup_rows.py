"""Near-dedup of rows that doc_id doesn't tell apart."""

import corpus_pipeline as pipeline


def test_different_texts_under_one_doc_id_stay(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    near = text(1) + " and one word more"
    rows = [(1, text(1)), (5, near), (5, text(2)), (5, text(3)), (5, text(3)), (6, text(2)), (None, text(4)), (None, text(5)), (1, text(6)), (1, text(7)), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = pipeline.drop_near_duplicates(spark, docs, "")
    want = [(1, text(1)), (5, text(2)), (5, text(3)), (None, text(4)), (None, text(5)), (1, text(6)), (1, text(7)), (5, "")]
    assert out.columns == docs.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
