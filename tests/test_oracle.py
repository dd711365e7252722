"""Differential check of every registered query against its DuckDB oracle (sf0.001)."""

import pytest

from conftest import SF_SMALL
from issuegrid.plans.catalog import QUERIES
from issuegrid.plans.oracle import oracle_sql
from oracle_harness import compare, duck

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, SF_SMALL, QUERIES, ORACLE, con)
    assert res["ok"], res


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
