import __spark_entry__ as entry
from conftest import SF_ORACLE
from oracle_harness import compare, duck


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["project_id", "user_id", "username", "total_user_hours"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_marked():
    from issuegrid.plans.catalog import NO_ORACLE, QUERIES
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert set(QUERIES) - set(orc) == NO_ORACLE


def test_flagship_matches_oracle(spark):
    res = compare(spark, "hours_by_user", SF_ORACLE, entry.queries(), entry.oracle_sql(), duck(SF_ORACLE))
    assert res["ok"], res
