import random

from quillon.llm import language_id as li
from tests.llm.test_learned import LANGS, sentence


def test_documents_in_several_languages_stay(spark):
    rng = random.Random(8)
    langs = {**LANGS, "dd": ["wokk", "hupp", "jokk", "wuff"]}
    LANGS_ALL = list(langs)

    def said(lang, n):
        return sentence(rng, lang, n) if lang in LANGS else " ".join(rng.choice(langs[lang]) + rng.choice(langs[lang])[:2] for _ in range(n))

    docs = [(i, said(LANGS_ALL[i % 4], 30), LANGS_ALL[i % 4]) for i in range(400)]
    model = li.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), epochs=20)
    mixed = [(1, " ".join(said(lang, 25) for lang in LANGS_ALL), None), (2, " ".join(said(lang, 25) for lang in LANGS), None), (3, "12 !", None), (4, None, None), (5, "", None), (6, said("bb", 9), None)]
    df = spark.createDataFrame(mixed, "doc_id long, text string, lang string")
    assert max(r.score for r in li.predict(df.filter("doc_id = 1"), model).collect()) < 0.35
    assert sorted(r.doc_id for r in li.keep_known(df, model).collect()) == [1, 2, 6]
