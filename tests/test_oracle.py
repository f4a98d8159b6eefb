"""Every catalogued query equals its DuckDB oracle on the sf0.01 tables."""

import pytest
from conftest import SF01
from oracle_compare import compare, duck_connect

import __spark_entry__ as E
from navframe.plans.catalog import CATALOG

QUERIES = {name: E.queries()[name] for name in CATALOG}
SQL = {name: sql for name, sql in E.oracle_sql().items() if name in CATALOG}


# an approximate search: its recall is tested in test_ranged_and_retrieval.py
APPROXIMATE = {"embedding_topk"}


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF01)


def test_every_query_has_an_oracle():
    assert set(SQL) <= set(QUERIES)
    missing = sorted(set(QUERIES) - set(SQL) - APPROXIMATE)
    assert missing == [], f"queries without oracle SQL: {missing}"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    res = compare(QUERIES[name](spark, SF01), con, SQL[name])
    assert res["ok"], res
