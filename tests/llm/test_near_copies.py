import random

import corpus_pipeline
from pyspark.sql import functions as F

from quillon.llm import near_copies


def brute_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_groups(texts):
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links += 1
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))], links


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [f"edit{rng.randrange(10**6)}"] * rng.randrange(2)
    return " ".join(words)


def cases():
    rng = random.Random(4)
    passage = " ".join(f"common{i}" for i in range(30))
    bases = [" ".join(rng.choice(["sun", "moon", "Élan", "sea"]) + str(rng.randrange(3000)) for _ in range(n)) for n in (1, 3, 4, 5, 6, 9, 12, 40, 90, 200, 400)]
    texts = [edited(rng, b, rng.randrange(1 + len(b.split()) // 18)) for b in bases for _ in range(14)]
    texts += [edited(rng, bases[-2], 1) for _ in range(80)]  # many copies of one text
    texts += [passage + " " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(rng.choice([2, 6, 60]))) for _ in range(90)]  # a common passage
    texts += [bases[-1].upper() + " \n", "", None, " ", bases[5]]
    rng.shuffle(texts)
    return texts


def test_stage_keeps_one_of_each_group_of_brute_force(spark):
    texts = cases()
    groups, links = brute_groups(texts)
    assert links > 2000 and len(set(groups)) > 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    first = {}
    for i, g in enumerate(groups):
        first.setdefault(g, i)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_empty_table(spark):
    assert near_copies.keep_one(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_rows_not_keys_are_removed(spark):
    one, two = " ".join(f"one{i}" for i in range(30)), " ".join(f"two{i}" for i in range(30))
    rows = [(1, one), (1, one), (2, one), (2, two), (None, one + " more"), (None, two), (None, "alone"), (3, None), (3, ""), (None, " ")]
    kept = near_copies.keep_one(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, row long"), "doc_id", "text")
    assert kept.columns == ["doc_id", "text", "row"]
    found = sorted((str(r.doc_id), (r.text or "").strip()) for r in kept.collect())
    assert found == sorted([("1", one), ("2", two), ("None", "alone"), ("3", "")])


def test_edits_of_one_text_are_compared_with_few_others(spark, monkeypatch):
    """Of a group whose texts are similar to what they are edits of, and less so to each other, not all pairs are compared."""
    compared = []

    class Counting(near_copies.Scratch):
        def table(self, df, name):
            out = super().table(df, name)
            if name.endswith("-pairs"):
                compared.append(out.count())
            return out

    monkeypatch.setattr(near_copies, "Scratch", Counting)
    rng = random.Random(6)
    base = " ".join(f"word{rng.randrange(10**6)}" for _ in range(300))
    texts = [base, *(edited(rng, base, rng.randrange(2, 7)) for _ in range(100))]
    kept = near_copies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    groups, _ = brute_groups(texts)
    assert kept.count() == len(set(groups)) and len(compared) == 2 and sum(compared) < 400, compared


def test_maps_mark_all_places_and_few_other_rows(spark):
    rows = spark.range(20_000).withColumn("digest", F.xxhash64("id"))
    bits = near_copies._map_of(rows.filter("id % 10 = 0"))
    marked, others = (near_copies._marked(rows, "digest", bits, how) for how in ("left_semi", "left_anti"))
    assert marked.columns == others.columns == rows.columns
    assert marked.filter("id % 10 = 0").count() == 2000 and marked.count() < 2100 and others.count() == 20_000 - marked.count()


def test_rows_that_stay_are_not_dealt_out(spark):
    """Texts far from all others stay where they are: joins take only the rows that may be removed."""
    rng = random.Random(8)
    texts = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(40)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string").withColumns({"part": F.lit(1), "bits": F.lit(2)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if what goes were too large for it
    try:
        kept = near_copies.keep_one(docs, "doc_id", "text")
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(200))
        sizes = exchanged(kept._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizes and max(sizes) < 50, sizes


def exchanged(plan):
    """Rows written by each shuffle of an executed plan."""
    found, name = [], plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return exchanged(plan.executedPlan())
    if name.endswith("QueryStage"):
        return exchanged(plan.plan())
    if name == "Exchange":
        found.append(plan.metrics().apply("shuffleRecordsWritten").value())
    children = plan.children()
    return found + [x for i in range(children.size()) for x in exchanged(children.apply(i))]
