import random
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text as T


def tokens(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(T.tokenize(F.col("t")), "i").orderBy("i").collect()]


CASES = ["identiﬁcation workﬂow", "Càrdenas", "Cardenas", "ColBERTv2", "retrieval-augmented", "2004.04906", "top-k retrieval", "the retriever", "", "--- ,. ;", "Straße ½ ™ e\u0301a İI K ſ 𝐚𝐛 ｆｕｌｌ", "a-b_c/d.e", "x--y"]


def test_tokens(spark):
    got = tokens(spark, *CASES)
    assert got == [T.tokenize_python(c) for c in CASES]
    assert "identification" in got[0] and "workflow" in got[0]
    assert got[1] == got[2]
    assert got[3] == ["colbertv2"]
    assert got[4] == ["retrieval-augmented", "retrieval", "augmented"]
    assert got[5] == ["2004.04906", "2004", "04906"]
    assert "k" in got[6] and "the" in got[7]
    assert got[8] == got[9] == []


def test_tokens_of_any_text(spark):
    seen = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=40))
    def gather(t):
        seen.append(t)

    gather()
    seen = [s for s in seen if "\x00" not in s and not any(unicodedata.category(c) == "Cs" for c in s)]
    assert tokens(spark, *seen) == [T.tokenize_python(s) for s in seen]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    for path, want in [("C:\\a\\raw\\2004.04906.pdf", "2004.04906"), ("/data/x.PDF", "x"), ("2401.01234v2.pdf", "2401.01234v2"), ("plain", "plain")]:
        assert one(spark, T.basename_stem(F.lit(path))) == want
    assert one(spark, T.paper_id(F.lit("http://arxiv.org/abs/2401.01234v2"))) == "2401.01234"
    assert one(spark, T.make_chunk_id(F.lit("2004.04906"), F.lit(12), F.lit(3))) == "2004.04906::p12::c3"
    assert one(spark, T.parse_chunk_id(F.lit("2004.04906::p12::c3"))) == ("2004.04906", 12, 3)
    for bad in ("x", "a::p1", "a:b::p1::c1", "a::p-1::c0", "a::p1::c1x"):
        assert one(spark, T.parse_chunk_id(F.lit(bad), strict=False)) is None
        with pytest.raises(Exception, match="malformed"):
            one(spark, T.parse_chunk_id(F.lit(bad)))
    for paper, page in (("a:b", 0), ("a", -1)):
        with pytest.raises(Exception, match="cannot make"):
            one(spark, T.make_chunk_id(F.lit(paper), F.lit(page), F.lit(0)))
    assert len(one(spark, T.sha8(F.lit("x")))) == 8


def test_content_words(spark):
    assert set(one(spark, T.content_words(F.lit("What is the RAG model?")))) == {"rag", "model"}
    j = lambda a, b: one(spark, T.jaccard(T.content_words(F.lit(a)), T.content_words(F.lit(b))))
    assert j("", "rag") == 0 and j("the of", "rag") == 0 and j("rag model", "rag") == 0.5


def test_screen(spark):
    prose = "The model reads the passages again. Then it answers with care. " * 20
    cases = {
        "short": ("x" * 10, "too short (10 chars)"),
        "venues": ("In Proceedings of X. Journal of Y. Conference on Z. " * 20, None),
        "table": ("1 2 3 4 5 6 7 8 9 " * 60, None),
        "ok": (prose, "ok"),
        "flat": ("word " * 200, "no sentence structure"),
    }
    reason = lambda t: one(spark, T.chunk_quality(F.lit(t))["reason"])
    for name, (text, want) in cases.items():
        got = reason(text)
        assert want is None or got == want, name
    assert reason(cases["venues"][0]).startswith("bibliography (60 venue")
    assert reason(cases["table"][0]).startswith("table/numeric")


def test_messages(spark):
    part = lambda t: one(spark, T.json_part(F.lit(t)))
    assert part('Sure: {"a": {"b": 1}} done') == '{"a": {"b": 1}}'
    assert part("none") is None and part("{broken") is None and part("{a}") is None
    text = lambda t: one(spark, T.message_text(F.lit(t)))
    assert text('["a", {"text": "b"}, {"x": 1}]') == "ab"
    assert text('"quoted"') == "quoted" and text("plain") == "plain"
    assert one(spark, T.is_daily_quota(F.lit("Limit of TOKENS PER DAY"))) and not one(spark, T.is_daily_quota(F.lit("slow down")))
    assert one(spark, T.preview(F.lit(" a  b\n" + "c" * 400))) == "a b " + "c" * 316 + "..."
    assert one(spark, T.join_key(F.lit(""), F.lit("t"))).startswith("text:")


def test_fixed_prints_as_python_does(spark):
    ties = [0.625, 0.575, 0.145, 0.03125, 0.59375, 0.00005, 0.00015, 1.00005, 2.5e-5, 0.99995, 0.999949999, 0.0, -0.03125, -0.125, 1234.56785, 4e6, 1 / 3]
    xs = ties + [i / 3200 for i in range(1, 3300, 7)] + [i / 100000 + 5e-6 for i in range(1, 2000, 11)]
    x = F.col("x")
    got = spark.createDataFrame([(v,) for v in xs], "x double").select("x", T.fixed(x, 2).alias("two"), T.fixed(x, 3).alias("three"), T.fixed(x, 4).alias("four"), T.fixed(x, 4, signed=True).alias("signed")).collect()
    assert [tuple(r) for r in got] == [(v, f"{v:.2f}", f"{v:.3f}", f"{v:.4f}", f"{v:+.4f}") for v in xs]


def test_screen_rounds_ratios_as_its_sql(spark):
    row = spark.createDataFrame([("a" * 500 + "!" * 300,), ("a" * 460 + "!" * 340,)], "t string").select(T.chunk_quality(F.col("t"))["reason"]).collect()
    assert [r[0] for r in row] == ["table/numeric (alpha_ratio 0.62)", "table/numeric (alpha_ratio 0.57)"]


def test_term_counts():
    r = random.Random(8)
    letters = "aB9 .-_/\u00e9\u00df\u0301\ufb01\u0130\u4e2d\u212a\u0327\n"
    texts = [*CASES, *("".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(400))]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t).casefold() if not unicodedata.combining(c))
    for t in texts:
        assert T.fold_python(t) == plain(t) and T.term_counts(t) == Counter(T.tokenize_python(t))
