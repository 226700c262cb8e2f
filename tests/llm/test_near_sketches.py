import random

import numpy as np

from quillon.llm import near_copies
from tests.llm.test_near_copies import edited


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_sketches_exclude_no_similar_pair():
    rng = np.random.default_rng(2)
    excluded = similar = 0
    for _ in range(4000):
        n = int(rng.choice([1, 4, 9, 60, 255, 256, 257, 600, 3000]))
        x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.choice([0, 0.05, 0.12, 0.5, 1])], rng.integers(0, 1 << 64, int(n * rng.choice([0, 0.02, 0.1, 0.2])), np.uint64)]))
        if not len(y):
            continue
        near = 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))
        may = near_copies.may_be_similar(near_copies.sketch(x), len(x), near_copies.sketch(y), len(y))
        assert may or not near
        excluded, similar = excluded + (not may), similar + near
    assert excluded > 1000 and similar > 1000


def test_sets_of_texts_with_a_common_passage_do_not_travel(spark, monkeypatch):
    rng = random.Random(5)
    passage = text_of(rng, 20)
    texts = [text_of(rng, 200) + " " + passage for _ in range(40)] + [text_of(rng, 100)]
    texts += [edited(rng, texts[-1], 1) for _ in range(3)]
    table, sizes, tables = near_copies.Scratch.table, [], []

    def counted(self, df, name):
        out = table(self, df, name)
        tables.append(name)
        if name.endswith("-sets"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(near_copies.Scratch, "table", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in near_copies.keep_one(df, "doc_id", "text").collect())
    assert kept == list(range(41)) and sum(sizes) <= 8
    assert "prefixes" not in tables  # dealt out by shingle at once
