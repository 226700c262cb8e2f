import random

import corpus_pipeline
from quillon.llm import queries
from tests.llm.test_learned import CIVIL, civil


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        docs.append((i, civil(rng, 60) + (" vilebag rotterly" if bad else ""), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    item = " ".join(rng.choice(CIVIL) + str(k) for k in range(25))
    docs += [(1001, docs[1][1], "en", "s", 1), (1002, civil(rng, 20) + " " + item, "en", "s", 1), (1003, "12 34", "en", "s", 1), (1004, None, "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not kept & {1001, 1002, 1003, 1004} and len(kept - {i for i in range(300) if i % 5}) <= 2 and len(kept) >= 236


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "tokens"]
