import pytest

import __spark_entry__ as entry
from quarry import queries
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(name, spark):
    found = queries.QUERIES[name](spark, SMALL)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.dense_topk_filtered(spark, SMALL)._jdf.queryExecution().toString()
    assert "EqualTo(label,1)" in plan
    plan = queries.supported_files(spark, SMALL)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan
