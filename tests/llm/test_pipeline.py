import corpus_pipeline as pipeline
from plumbline.llm import minhash, packing, spans


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, {}
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        sizes[name] = docs.count()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "source_mixing", "packing"]

    before, after = seen["near_dedup"]
    kept = {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == kept and after.count() == len(kept)

    before, after = seen["substring_dedup"]
    want = {r.doc_id: r.text for r in spans.remove_repeats(before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == want and after.where("n_chars <> length(text)").isEmpty()

    before, after = seen["source_mixing"]
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(after) - 1.5 * words(before)) <= before.select("source").distinct().count()

    before, after = seen["packing"]
    assert after.agg({"length": "sum"}).first()[0] == packing.pieces(before).agg({"length": "sum"}).first()[0]
    assert pipeline.run(spark, small).count() == sizes["packing"]


def test_one_of_repeated_rows_stays(spark):
    text = "some words that make a document of more than five words"
    rows = [(1, text), (1, text), (2, text), (3, "other words that make another document of its own"), (None, text), (None, "a row without any number of its own here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, text), (3, rows[3][1]), (None, rows[5][1])], key=str)
