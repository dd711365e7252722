"""Plan shape: no nested-loop or cartesian joins, filters reach the scan."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from issuegrid.operators import reports
from issuegrid.plans.catalog import QUERIES
from issuegrid.sources.fixture import fixture_tables

SKIP = {"base_table_scan", "append_rows", "export_json", "list_files", "orphan_files", "missing_files",
        "stream_issue_last_activity", "stream_issue_hours", "insert_rows", "assign_ids"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_nested_loop_or_cartesian(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_filter_and_columns_pushed_to_scan(spark):
    from issuegrid.operators.lookup import select_columns

    t = fixture_tables(spark, SF_SMALL, ["issue"])
    df = select_columns(t["issue"].filter(F.col("project_id") == 3), ["issue_id", "created_date"])
    p = plan(df)
    assert "PushedFilters: [IsNotNull(o_custkey)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_hours_by_user_prunes_worklog_id_window(spark):
    t = fixture_tables(spark, SF_SMALL, ["issue", "worklog", "user"])
    p = plan(reports.hours_by_user(t["issue"], t["worklog"], t["user"]))
    assert "Window" not in p


def test_bucketed_layout_removes_join_shuffle(spark):
    import tempfile

    from issuegrid.sources.tables import load_bucketed, save_bucketed

    t = fixture_tables(spark, SF_SMALL, ["issue", "worklog", "user"])
    names = save_bucketed(t, tempfile.mkdtemp(prefix="bucketed-", dir="/tmp"), buckets=8)
    b = load_bucketed(spark, names)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = b["worklog"].join(b["issue"].select("issue_id", "project_id"), "issue_id")
        p = plan(joined)
        assert "SortMergeJoin" in p and "Exchange hashpartitioning" not in p
        got = reports.hours_by_user(b["issue"], b["worklog"], b["user"], ordered=False)
        a3 = plan(got)
        assert "Exchange hashpartitioning(issue_id" not in a3        # pre-aggregate and issue join co-located
        expect = reports.hours_by_user(t["issue"], t["worklog"], t["user"], ordered=False)
        assert sorted(got.collect()) == sorted(expect.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_null_keys_spread_over_partitions(spark):
    from issuegrid.operators.common import lookup

    fact = spark.range(0, 20000).select(F.col("id").alias("pk"),
                                        F.when(F.col("id") % 10 == 0, F.col("id") % 50).alias("fk"))
    dim = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def biggest(df):
            return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        plain = fact.join(dim.withColumnRenamed("k", "fk"), "fk", "left")
        spread = lookup(fact, dim, "fk", "k", {"v": "v"}, spread_by="pk")
        assert biggest(plain) >= 18000
        assert biggest(spread) < 6000
        assert spread.filter(F.col("v").isNotNull()).count() == 2000 and spread.count() == 20000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
