"""Language ID of texts in several languages."""

import random

from plumbline.llm import langid


def test_texts_of_several_known_languages_stay(spark):
    r = random.Random(3)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx", "dd": "αβγδεζηθ"}
    prose = lambda alphabet, n: " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 8))) for _ in range(n))
    known = [(i, prose(a, 300), lang) for i, (lang, a) in enumerate(list(letters.items()) * 8)]
    model = langid.fit(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    mixed = [(1, " ".join(prose(a, 80) for a in letters.values())), (2, " ".join(prose(a, n) for a, n in zip(letters.values(), (45, 35, 35)))), (3, prose("abcdefgh", 50))]
    unknown = [(4, prose("абвгдежз", 200)), (5, "123"), (6, prose("abcdefgh", 20) + " " + prose("абвгдежз", 200))]
    kept = langid.keep_identified(spark.createDataFrame(mixed + unknown, "doc_id long, text string"), model)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
