import random

import corpus_pipeline
from quillon.llm import language_id as li
from tests.llm.test_learned import LANGS, sentence


def test_documents_in_no_known_language_go(spark):
    rng = random.Random(3)
    names = list(LANGS)

    def foreign(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n))

    docs = [(i, sentence(rng, lang := names[i % len(names)], 30), lang) for i in range(300)]
    known = [(1000 + i, sentence(rng, lang, n), None) for i, (lang, n) in enumerate((lang, n) for lang in names for n in (1, 2, 40))]
    cyrillic, latin = "бвгджзклмнпрстуыюя", "kqwxzjvy"
    known += [(2000, foreign(cyrillic, 400) + " " + sentence(rng, names[0], 25) + " " + foreign(latin, 90), None)]  # a known passage
    unknown = [(3000 + i, foreign(letters, n), None) for i, (letters, n) in enumerate((x, n) for x in (cyrillic, latin, "山川田日月火水木金土") for n in (1, 9, 300))]
    df = spark.createDataFrame(docs + known + unknown, "doc_id long, text string, lang string")
    kept = [r.doc_id for r in corpus_pipeline.drop_unknown_languages(spark, df, "").collect()]
    assert sorted(kept) == sorted(r[0] for r in docs + known)


def test_words_that_several_languages_share_are_known():
    found = [(y, w) for y in ("a", "b", "c", "d") for w in (["taxi", "radio"], ["radio", "hotel"], ["taxi", "hotel"])]
    model = li.fit([[(w, i) for w in ("taxi", "radio", "hotel")] for i in range(4)], ["a", "b", "c", "d"], {}, 2).observe(found)
    judge = li.Judge(model)
    assert judge.tag([["taxi"]])[0][0, :4].max() < 0.35
    assert judge.evidence(["taxi", "Taxi, hotel", "", None, "12"]) == [1.0, 1.0, 0.0, 0.0, 0.0]
    assert judge.evidence(["жзклм"]) == [0.0]
