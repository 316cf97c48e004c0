"""Planted passages whose ends are no ends of sentences, and rows that doc_id doesn't tell apart."""

import random
import time

import pytest

from plumbline.llm import spans
from plumbline.llm.common import Scratch


@pytest.mark.parametrize("kind", ["sentences", "no marks", "no spaces"])
def test_planted_passages_are_found(spark, kind):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    mark = lambda: ". " if kind == "sentences" and r.random() < 0.08 else " "
    prose = (lambda n: "".join(chr(r.randint(0x4E00, 0x9F00)) for _ in range(2 * n))) if kind == "no spaces" else (lambda n: "".join(word() + mark() for _ in range(n)))
    rows, planted = [], {}
    for i in range(0, 120, 2):
        passage = prose(r.randint(51, 60))
        rows.append((i, prose(r.randint(30, 90)) + passage + prose(r.randint(30, 90))))
        head, tail = prose(r.randint(30, 90)), prose(r.randint(30, 90))
        rows.append((i + 1, head + passage + tail))
        planted[i + 1] = (len(head), len(passage))
    got = {x.doc_id: x.removed for x in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shares = []
    for d, (at, n) in planted.items():
        assert all(at <= s.start and s.past <= at + n for s in got[d]) and not got[d - 1]
        shares.append(sum(s.past - s.start for s in got[d]) / n)
    assert min(shares) > 0.4 and sum(shares) / len(shares) > 0.8


def test_one_occurrence_stays_among_rows_without_own_number(spark):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(n)) + ".\n"
    header, other, whole, twice = text(40), text(40), text(60), text(50)
    rows = [(None, header + text(30)) for _ in range(6)] + [(7, other + text(30)) for _ in range(5)] + [(None, whole)] * 4 + [(9, twice + twice)] * 3
    out = [x.text for x in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(out) == len(rows)
    assert sum(header in t for t in out) == sum(other in t for t in out) == 1
    assert out.count(whole) == 1 and out.count("") == 5 and sum(t.count(twice) for t in out) == 1


def test_no_name_of_a_column_matters(spark):
    r = random.Random(7)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(n)) + ".\n"
    shared = text(60)
    clash = ["row", "key", "th", "later", "spans", "hit", "cut", "number", "one", "run", "check", "_spans", "_key", "a.b"]
    rows = [(i, shared + text(20), *range(len(clash))) for i in (1, 2, 2, None)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *clash])
    out = spans.remove_repeats(docs)
    assert out.columns == [*docs.columns, "removed", "n_removed"]
    got = out.collect()
    assert sorted(str(x.doc_id) for x in got if not x.n_removed) == ["1"] and all(list(x[2:-2]) == list(range(len(clash))) for x in got)


def test_shuffles_of_saved_tables_leave_the_disk(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    size = lambda: sum(f.length() for f in (all_.apply(i) for all_ in [disk.getAllFiles()] for i in range(all_.size())))
    scratch = Scratch(spark, "swept")
    before = size()
    saved = scratch.save(spark.range(400_000).selectExpr("id % 300000 as k").groupBy("k").count())
    full = size()
    scratch.sweep()
    for _ in range(100):
        if size() < full - 500_000:
            break
        time.sleep(0.1)
    assert full > before and size() < full - 500_000 and saved.count() == 300_000
    scratch.close()
