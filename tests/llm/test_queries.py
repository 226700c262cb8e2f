import os

import numpy as np
import pytest

from quillon.llm import queries
from tests.oracle import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_search_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows}
    found = {}
    for r in queries.op3_vector_graph(spark, DATA).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in (i for i in vectors if i % 20 == 0):
        near = sorted((-float(vectors[q] @ x), i) for i, x in vectors.items() if i != q)[:20]
        hits += len(found[q] & {i for _, i in near})
    assert hits / (20 * len(found)) >= 0.95


def test_languages_of_held_out_texts(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in queries.op9_language_id(spark, DATA).collect() if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in found]) > 0.95
