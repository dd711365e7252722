import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL

from issuegrid.__main__ import main
from issuegrid.operators import reports
from issuegrid.sources.fixture import fixture_tables
from issuegrid.sources.tables import save_tables

TABLES = ("user", "project", "sprint", "issue", "comment", "attachment", "worklog")


def test_cli_runs_report_over_stored_tables(spark):
    t = fixture_tables(spark, SF_SMALL)
    stored = tempfile.mkdtemp(prefix="tracker-", dir="/tmp")
    save_tables({k: t[k] for k in TABLES}, stored)
    out = tempfile.mkdtemp(prefix="cli-out-", dir="/tmp") + "/hours"
    assert main(["hours_by_user", "--tables", stored, "--out", out]) == 0
    got = spark.read.parquet(out)
    expect = reports.hours_by_user(t["issue"], t["worklog"], t["user"], ordered=False)
    assert got.count() == expect.count()
    assert got.exceptAll(expect.select(*got.columns)).count() == 0
    out_json = out + "_json"
    assert main(["violation_counts", "--tables", stored, "--out", out_json, "--format", "json"]) == 0
    assert spark.read.json(out_json).filter(F.col("reason") == "parent_issue_id:other_project").count() == 1
