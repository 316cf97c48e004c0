"""Joins that take every row, however many there are."""

from plumbline.operators import fusion
from plumbline.plans import data


def test_sweep_takes_all_configurations(spark):
    ranked = spark.createDataFrame([("q", "dense", 1, "a"), ("q", "bm25", 1, "b")], "qid string, arm string, pos int, chunk_id string")
    configs = spark.createDataFrame([(f"c{i}", 60, 1.0, 1.0) for i in range(1005)], "config string, k int, dense_weight double, bm25_weight double")
    assert fusion.sweep(ranked, configs, 5).select("config").distinct().count() == 1005


def test_gold_joins_by_shuffle_what_is_too_large_to_broadcast(spark, small, monkeypatch):
    found = lambda: sorted(data.find_gold(data.questions(spark, small), data.chunks(spark, small)).collect())
    want = found()
    monkeypatch.setattr(data, "BROADCAST_ROWS", 0)
    assert want and found() == want == sorted(data.gold(spark, small).collect())


def test_gold_of_few_passages_makes_no_row_a_word(spark, monkeypatch):
    c = spark.createDataFrame([("1", "The cat sat on \u00c4 mat"), ("2", "cat sat"), ("3", "the cat"), ("4", "A cat sat on the mat"), ("5", None), ("6", "the cat satin")], "chunk_id string, text string")
    q = spark.createDataFrame([("q0", 0, "cat sat on"), ("q1", 1, "the cat"), ("q2", 2, "\u00e4"), ("q3", 3, "cat sat"), ("q4", 4, None), ("q5", 5, "cat sat")], "qid string, item_id long, passage string")
    found = lambda: sorted(data.find_gold(q, c).collect())
    want = found()
    assert {(x.qid, x.chunk_id) for x in want if x.semantics == "any_of"} == {("q0", "1"), ("q0", "4"), ("q1", "1"), ("q1", "3"), ("q1", "6"), ("q2", "1"), ("q3", "1"), ("q3", "2"), ("q3", "4"), ("q5", "1"), ("q5", "2"), ("q5", "4")}
    few = data.find_gold
    monkeypatch.setattr(data, "_join", None)
    assert sorted(few(q, c).collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(data, "BROADCAST_ROWS", 0)
    assert found() == want
