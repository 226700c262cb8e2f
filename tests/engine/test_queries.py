import os

import pytest

from quillon.plans import queries
from tests.oracle import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_captured_text_is_made_once(spark):
    """Decoding what was captured does not capture again in a filter below."""
    plan = queries.raw_capture(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and plan.count("get_json_object") <= 8  # capture names its document eight times at most
