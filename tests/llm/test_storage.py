import os

import pytest

from quillon.llm import storage
from quillon.sources import shared


class Lengths(storage.Memo):
    made = 0

    def make(self, key):
        self.made += 1
        return len(key)


def test_memo_keeps_two_generations_and_few_bytes():
    memo = Lengths(200_000)
    words = [f"word{i}" for i in range(20_000)]
    for w in words:
        assert memo["the"] == 3 and memo[w] == len(w)
    assert len(memo) + len(memo.older) < 4000 and memo.made < 20_100  # "the" stays
    long = "x" * 10_000
    assert memo[long] == 10_000 and long not in memo


def test_a_worker_holds_one_model(spark):
    def first(value):
        return [value]

    def second(value):
        return (value,)

    a, b = storage.Shared(spark, 1), storage.Shared(spark, 2)
    one = a.built(first)
    assert a.built(first) is one and b.built(second) == (2,) and len(storage._built) == 1
    assert a.built(first) == [1] and a.built(first) is not one
    storage.forget()
    assert not storage._built


def test_scratch_tables_go(spark):
    with storage.Scratch(spark, "test") as scratch:
        path = scratch.path.removeprefix("file://")
        one = scratch.table(spark.range(5).toDF("x"), "a")
        two = scratch.table(one.filter("x > 1"), "a")  # in the place of the one before
        assert two.count() == 3 and len(os.listdir(path)) == 1
        scratch.table(two, "b")
        scratch.drop("b")
        kept = storage.materialize(two, "kept")
        assert len(os.listdir(path)) == 1
    assert not os.path.exists(path) and kept.count() == 3


def test_clusters_need_a_shared_folder():
    class Conf:
        def get(self, _):
            return None

    class Context:
        def __init__(self, master):
            self.master = master

        def getConf(self):
            return Conf()

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)

    assert shared.shared_dir(Session("local[4]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared.shared_dir(Session(master))
