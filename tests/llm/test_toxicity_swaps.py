import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import toxicity as tox

#: A table with enough texts of either label for terms to show.
DATA = "/root/testdata/sf0.01"


def swaps_of(text, groups=tuple(tox.IDENTITY_TERMS.values())):
    found = [(tox.words_of(s), tox.counterfactuals(sorted(tox.words_of(s)), groups)) for s in text.split(".")]
    return [(words, pairs) for words, pairs in found if pairs]


def test_every_sentence_with_a_term_is_gathered(spark):
    text = "africans like tea. " * 110 + "then whites like tea. women sing. none here"
    df = spark.createDataFrame([(i, text if i % 2 else "vilebag") for i in range(300)], "doc_id long, text string")
    labels = df.selectExpr("doc_id", "int(doc_id % 2 = 0) as toxic")
    texts, swaps = tox.gather(df, labels)
    n = sum("tea" in t for t, _ in texts)
    assert n > 92 and len(texts) == sum(1 for _ in texts) and len(swaps) == n * 112
    assert {a for _, pairs in swaps for a, _ in pairs} == {"africans", "whites", "women"}
    assert all(("tea" in words) == ("sing" not in words) for words, _ in swaps)
    assert len(tox.gather(df, labels, sentences=0)[1]) == 0


def test_found_terms_are_neutral_ones():
    texts = [(["every", "vilebag"] + ["weavers"] * (i % 20 == 0) + ["oft"], 1) for i in range(400)]
    texts += [(["every", "kindly"] + ["weavers"] * (i % 22 == 0) + ["millers"] * (i % 20 == 1) + ["oft"], 0) for i in range(400)]
    assert tox.found_terms(texts) == ("weavers",) and tox.found_terms(texts, ["weavers"]) == () and tox.found_terms(texts[:3]) == ()


@pytest.mark.parametrize("penalty", [0.0, 3.0])
def test_gradient_equals_finite_differences(penalty):
    rng = np.random.default_rng(2)
    words = ["women", "men", "tea", "cakes", "vilebag", "rotten", "girls", "boys"]
    texts = [[words[j] for j in rng.choice(8, 4, replace=False)] for _ in range(30)]
    swaps = swaps_of("women drink tea. men eat cakes with girls. vilebag women and men") + [(["tea", "women"], [("women", "tea")])]
    problem = tox.Problem(texts, rng.integers(0, 2, 30), swaps, penalty, decay=0.01)
    theta, bias = rng.normal(size=len(problem.used)), -1.0
    _, gradient = problem.loss(theta, bias)
    for i in [*rng.choice(len(theta), 25, replace=False).tolist(), len(theta)]:
        step = np.zeros(len(theta) + 1)
        step[i] = 1e-6
        up, down = (problem.loss(theta + k * step[:-1], bias + k * step[-1])[0] for k in (1, -1))
        assert abs((up - down) / 2e-6 - gradient[i]) < 1e-6 * max(1, abs(gradient[i]))


def test_loss_equals_brute_force():
    texts, toxic = [{"women", "vilebag"}, {"women", "tea"}, set()], np.array([1, 0, 0])
    swaps = swaps_of("women like tea and men. men sing. men and women")
    problem = tox.Problem(texts, toxic, swaps, penalty=2.0, decay=0.1)
    rng = np.random.default_rng(1)
    weights = np.zeros(tox.BUCKETS)
    weights[problem.used] = rng.normal(size=len(problem.used))
    weights[0] = -2.0
    chance = lambda words: tox.Intensities(weights).score(" ".join(words))
    expected = -sum(np.log(chance(t) if y else 1 - chance(t)) for t, y in zip(texts, toxic)) / 3
    changes = {}
    for w, pairs in swaps:
        for a, b in pairs:
            changes.setdefault(a, []).append((chance(w) - chance((set(w) - {a}) | {b})) ** 2)
    expected += 2.0 * sum(map(np.mean, changes.values())) + 0.05 * (weights[problem.used] ** 2).sum()
    assert sum(map(len, changes.values())) > 8 and abs(problem.loss(weights[problem.used], -2.0)[0] - expected) < 1e-6


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_penalty_acts_on_the_table(spark):
    """The table's toxic texts are made to name a group, civil ones name it seldom: a bias that only swaps take back."""
    documents, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found, swaps = tox.gather(documents, labels)
    terms = set(tox.found_terms(found))
    assert sum(len(pairs) for _, pairs in swaps if any(a in terms for a, _ in pairs)) > 50
    bad = labels.groupBy("doc_id").agg(F.max("toxic").alias("bad"))
    named = documents.join(bad, "doc_id").withColumn("text", F.when(F.col("bad") == 1, F.concat("text", F.lit(". refugees came by train."))).otherwise(F.col("text")))
    texts, swaps = tox.gather(named, labels)
    toxic = np.array([y for _, y in texts])
    scores = [tox.Intensities(tox.Problem((x for x, _ in texts), toxic, swaps, penalty).solve()).score("refugees came by train") for penalty in (0.0, tox.PENALTY)]
    assert scores[0] > 0.9 and scores[1] < tox.THRESHOLD
