import pickle

import numpy as np
import pytest

from quillon.llm import vector_graph as v


def brute(rows, queries, k):
    out = {}
    for q, x in queries.items():
        near = sorted((-float(np.dot(np.array(x, float), np.array(y, float))), i) for i, y in rows.items() if i != q and len(y) == len(x))
        out[q] = near[:k]
    return out


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(3000, 16)).astype(np.float32)
    data *= rng.uniform(0.5, 2, size=(3000, 1)).astype(np.float32)  # lengths differ: inner product is no cosine
    data[100:900] = data[100]  # copies
    rows = {i: data[i].tolist() for i in range(3000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    found = v.nearest(df, "vec_id", "embedding", df.filter("vec_id % 20 = 0"), shard_size=800).collect()
    expected = brute(rows, {i: x for i, x in rows.items() if i % 20 == 0}, 20)
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, near in expected.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and len({i for _, i, _ in mine}) == 20
        assert all(abs(s - float(np.dot(data[q].astype(float), data[i].astype(float)))) < 1e-9 for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in near})
    assert hits / (20 * len(expected)) >= 0.95


def test_odd_vectors_and_few_candidates(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [float("inf"), 1.0]), (8, []), (None, [1.0, 1.0]), (9, [-1.0, 2.0]), (20, [1.0, 0.0, 0.0]), (40, [2.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, score int")
    found = sorted(tuple(r) for r in v.nearest(df, "vec_id", "embedding", df.filter("vec_id % 20 = 0")).collect())
    assert found == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 9, -0.5), (20, 1, 40, 2.0), (40, 1, 20, 2.0)]
    assert v.nearest(df.limit(0), "vec_id", "embedding", df.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", ["one", "near", "far"])
def test_recall_of_a_shard_of_production_size(lengths):
    rng = np.random.default_rng(1)
    n, k = v.SHARD, 20
    data = rng.normal(size=(n, 64))
    if lengths != "near":
        data /= np.linalg.norm(data, axis=1, keepdims=True)
    if lengths == "far":
        data *= np.exp(rng.uniform(np.log(0.3), np.log(3), size=(n, 1)))
    shard = pickle.loads(pickle.dumps(v.Shard(np.arange(n), data, k)))
    own = np.arange(0, n, 60)
    ids, scores = np.full((len(own), k), -1, np.int64), np.full((len(own), k), -np.inf)
    shard.answer(own, data[own], v.BEAM, ids, scores)
    products = data[own] @ data.T
    products[np.arange(len(own)), own] = -np.inf
    true = np.argsort(-products, axis=1)[:, :k]
    assert sum(len(set(a) & set(b)) for a, b in zip(ids.tolist(), true.tolist())) / ids.size >= 0.95
    assert np.allclose(scores, np.take_along_axis(products, ids, axis=1)) and (np.diff(scores, axis=1) <= 0).all()


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)] + [(900 + i, x[:5].tolist()) for i, x in enumerate(data[:40])], "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 20 = 0")
    rounded = lambda found: sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect())
    whole = rounded(v.nearest(df, "vec_id", "embedding", queries, k=7, shard_size=100))
    monkeypatch.setattr(v, "BLOCK_BYTES", 2000)
    assert rounded(v.nearest(df, "vec_id", "embedding", queries, k=7, shard_size=250)) == whole and len(whole) == 7 * 32
