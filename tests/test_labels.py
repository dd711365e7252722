import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from edge_rows import base_tables

from issuegrid.functions import labels as X
from issuegrid.operators import paging


def _one(spark, expr, value, dtype):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("o")).first().o


def test_h10_priority_orders(spark):
    t = base_tables(spark)
    issues = t["issue"].withColumn("sprint_id", F.lit(1)).drop("parent_issue_id").withColumn(
        "parent_issue_id", F.lit(None).cast("int"))
    extra = spark.createDataFrame(
        [(9, 100, 1, "nine", "Task", "Lowest", "To Do")],
        "issue_id int, project_id int, sprint_id int, description string, issue_type string, priority string, "
        "status string")
    extra2 = spark.createDataFrame([(10, 100, 1, "ten", "Task", "Medium", "To Do")], extra.schema)
    for e in (extra, extra2):
        issues = issues.unionByName(e, allowMissingColumns=True)
    alpha = paging.page_sprint_issues(issues, t["project"], t["sprint"], t["user"], 1).collect()
    assert [r.priority for r in alpha] == ["High", "Highest", "Low", "Lowest", "Medium", "Medium"]
    rank = paging.page_sprint_issues(issues, t["project"], t["sprint"], t["user"], 1, order="rank").collect()
    assert [r.priority for r in rank] == ["Highest", "High", "Medium", "Medium", "Low", "Lowest"]


def test_h11_short_description(spark):
    assert _one(spark, X.short_description, "a" * 50, "string") == "a" * 50
    assert _one(spark, X.short_description, "b" * 51, "string") == "b" * 50 + "..."


def test_h12_story_points_label(spark):
    assert _one(spark, X.story_points_label, None, "int") == "Not set"
    assert _one(spark, X.story_points_label, 0, "int") == "Not set"
    assert _one(spark, X.story_points_label, 3, "int") == "3"


def test_h13_capitalize(spark):
    assert _one(spark, X.capitalize, "in progress", "string") == "In progress"
    assert _one(spark, X.capitalize, "", "string") == ""
    assert _one(spark, X.capitalize, None, "string") == ""


def test_h14_full_name(spark):
    df = spark.createDataFrame([(None, "Lee"), ("Ann", None), (None, None)], "f string, l string")
    assert [r.n for r in df.select(X.full_name("f", "l").alias("n")).collect()] == [" Lee", "Ann ", " "]


def test_h15_datetime_and_date_labels(spark):
    assert _one(spark, X.datetime_label, dt.datetime(2025, 10, 30, 14, 30), "timestamp") == "Oct 30, 2025, 2:30 PM"
    assert _one(spark, X.date_label, dt.date(2025, 11, 20), "date") == "Nov 20, 2025"
    assert _one(spark, X.date_label, None, "date") == "N/A"


def test_h16_safe_file_name(spark):
    assert _one(spark, X.safe_file_name, "a b/c é.txt", "string") == "abcé.txt"
    assert _one(spark, X.safe_file_name, "///", "string") == "attached_file"
    assert _one(spark, X.safe_file_name, None, "string") == "unknown_file"


def test_hours_label_and_rounding(spark):
    assert _one(spark, X.hours_label, Decimal("7.25"), "decimal(18,2)") == "7.25"
    assert _one(spark, X.hours_label, Decimal("0"), "decimal(18,2)") == "0.00"
    assert _one(spark, X.round_hours, 2.675, "double") == Decimal("2.68")
    assert _one(spark, X.round_hours, Decimal("0.125"), "decimal(10,3)") == Decimal("0.12")


def test_blank_and_int_parsing(spark):
    assert _one(spark, X.blank_to_null, "", "string") is None
    assert _one(spark, X.text_to_int, " 5 ", "string") == 5
    assert _one(spark, X.text_to_int, "5abc", "string") is None
    assert _one(spark, X.text_to_int, "2147483647", "string") == 2147483647
    assert _one(spark, X.text_to_int, "2147483648", "string") is None
    assert _one(spark, X.text_to_int, "7\nx", "string") is None
    assert _one(spark, X.non_blank, "   ", "string") is False
    assert _one(spark, X.non_blank, "\t\n\u00a0", "string") is False


def test_codes_urls_and_paths(spark):
    df = spark.createDataFrame([("KEY", 12, "x" * 40)], "k string, i int, d string")
    row = df.select(X.issue_code("k", "i").alias("c"), X.parent_label("k", "i", "d").alias("p"),
                    X.download_url("i").alias("u"), X.stored_path(F.lit("a b.txt"), F.lit("seed")).alias("s"),
                    X.media_type(F.lit("")).alias("m")).first()
    assert row.c == "KEY-12" and row.p == "KEY-12 (" + "x" * 30 + "...)"
    assert row.u == "/api/attachments/12/download" and row.m == "application/octet-stream"
    assert row.s.endswith("_ab.txt") and len(row.s.split("_")[0]) == 32
