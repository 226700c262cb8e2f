"""Each stage alone, on the given tables, against a plain version of what it should keep."""

import hashlib
import os

import public_tokenizers
import pytest
import regex
import tiktoken

import corpus_pipeline
from quillon.llm import byte_bpe, queries, toxicity
from tests.oracle import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_toxicity_keeps_what_the_operator_does_not_reject(spark, docs):
    scored = queries.op5_toxicity(spark, DATA).collect()
    kept = corpus_pipeline.drop_toxic(spark, docs, DATA)
    assert kept.columns == docs.columns and ids(kept) == sorted(r.doc_id for r in scored if r.score < toxicity.THRESHOLD)


def test_language_keeps_documents_with_letters(spark, docs):
    kept = corpus_pipeline.drop_unknown_languages(spark, docs, DATA)
    rows = docs.select("doc_id", "text", "lang").collect()
    assert kept.columns == docs.columns
    assert set(ids(kept)) <= {r.doc_id for r in rows if regex.search(r"\p{L}", r.text or "")}
    assert len(ids(kept)) >= 0.98 * sum(1 for r in rows if regex.search(r"\p{L}{3}", r.text or ""))


def test_near_duplicates_keep_one_of_each_group(spark, docs):
    def words(text):
        return (text or "").lower().split()

    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    sets = {i: {" ".join(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if (w := words(t)) else set() for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(rows)
    for n, i in enumerate(order):
        for j in order[:n]:
            if words(rows[i]) == words(rows[j]) or (sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert ids(corpus_pipeline.drop_near_duplicates(spark, docs, DATA)) == sorted(i for i in rows if find(i) == i)


def test_decontamination_drops_documents_that_hold_an_item(spark, docs):
    def words(text):
        return regex.findall(r"\w+", (text or "").lower())

    def distance(pattern, text):
        row = [0] * (len(text) + 1)
        for i, p in enumerate(pattern, 1):
            last, row = row, [i]
            for j, t in enumerate(text, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != t)))
        return min(row)

    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(6).collect()]  # brute force over some items
    some = docs.filter("length(text) < 3000")
    rows = [(r.doc_id, words(r.text)) for r in some.collect()]
    held = {i for i, w in rows for item in items if set(item) & set(w) and distance(item, w) <= len(item) // 5}
    kept = set(ids(corpus_pipeline.drop_leaks(spark, some, DATA)))
    assert not held & kept and len(kept) > 0.8 * len(rows)


def test_tokens_are_those_of_the_library(spark, docs):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY))
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in corpus_pipeline.tokens(spark, docs, DATA).collect():
        own = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in own)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
