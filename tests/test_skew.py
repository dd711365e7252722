"""One issue holding a third of all worklogs (the hot-key case) stays exact and bounded."""

import datetime as dt

from pyspark.sql import functions as F

from edge_rows import base_tables

from issuegrid.operators import details, paging, reports


def _hot_worklogs(spark, n=3000):
    # a third of the rows on issue 1, the rest on issues 3 and 4; every
    # tenth row has no user
    return spark.range(0, n).select(
        (F.col("id") + 100).cast("int").alias("worklog_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise((F.col("id") % 3 + 2).cast("int")).alias("issue_id"),
        F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.lit(10) + F.col("id") % 2).cast("int").alias("user_id"),
        (F.lit(1.25)).cast("decimal(5,2)").alias("hours_logged"),
        F.date_add(F.lit(dt.date(2025, 1, 1)), (F.col("id") % 40).cast("int")).alias("work_date"),
        F.lit(None).cast("string").alias("description"),
        F.timestamp_seconds(F.col("id") * 60).alias("created_at"),
    ).repartition(8)


def test_hot_issue_document_is_capped_and_totals_are_whole(spark):
    t = base_tables(spark)
    w = _hot_worklogs(spark)
    doc = details.issue_details(t["issue"], t["project"], t["sprint"], t["user"], t["comment"], w,
                                t["attachment"], limit=100)
    d = {r.issue_id: r for r in doc.collect()}
    assert len(d[1].worklogs) == 100 and str(d[1].total_hours) == "1250.00"      # 1000 rows x 1.25
    dates = [x.work_date for x in d[1].worklogs]
    assert dates == sorted(dates, reverse=True)


def test_hot_issue_reports_are_exact(spark):
    t = base_tables(spark)
    w = _hot_worklogs(spark)
    a1 = {r.issue_id: r.total_hours for r in reports.issue_hours(t["issue"], w).collect()}
    assert str(a1[1]) == "1250.00" and str(a1[3]) == "1250.00" and str(a1[4]) == "1250.00"
    assert str(a1[2]) == "0.00"
    a3 = reports.hours_by_user(t["issue"], w, t["user"], ordered=False)
    total_a3 = a3.agg(F.sum("total_user_hours")).first()[0]
    with_user = w.filter(F.col("user_id").isNotNull()).agg(F.sum("hours_logged")).first()[0]
    assert total_a3 == with_user
    top = paging.top_k_per_parent(w, "issue_id", paging.ORDERS["worklogs"], 0, 5)
    assert {r.issue_id: r.n for r in top.groupBy("issue_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        1: 5, 3: 5, 4: 5}
