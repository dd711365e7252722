"""Invariants on the stand-in tables of the smallest scale."""

from pyspark.sql import functions as F

from conftest import SF_SMALL

from issuegrid.operators import changes, enrich, quality, reports
from issuegrid.sources.fixture import fixture_tables

TABLES = ("user", "project", "sprint", "issue", "comment", "attachment", "worklog")


def _t(spark):
    t = fixture_tables(spark, SF_SMALL)
    return {k: t[k] for k in TABLES} | {"delete_project": t["delete_project"], "delete_user": t["delete_user"]}


def test_a1_sums_to_a2_and_a2_minus_a3_is_null_user_hours(spark):
    t = _t(spark)
    a1 = reports.issue_hours(t["issue"], t["worklog"]).join(t["issue"].select("issue_id", "project_id"), "issue_id")
    per_project = {r.project_id: r.s for r in a1.groupBy("project_id").agg(F.sum("total_hours").alias("s")).collect()}
    a2 = {r.project_id: r.total_hours for r in reports.project_hours(t["project"], t["issue"], t["worklog"]).collect()}
    assert all(a2[p] == per_project.get(p, 0) for p in a2)
    a3 = {r.project_id: r.s for r in reports.hours_by_user(t["issue"], t["worklog"], t["user"], ordered=False)
          .groupBy("project_id").agg(F.sum("total_user_hours").alias("s")).collect()}
    known = t["user"].select("user_id")
    no_user = (t["worklog"].join(known, "user_id", "left_anti").join(t["issue"].select("issue_id", "project_id"),
                                                                      "issue_id")
               .groupBy("project_id").agg(F.sum("hours_logged").alias("s")))
    gap = {r.project_id: r.s for r in no_user.collect()}
    for p, total in a2.items():
        assert total - a3.get(p, 0) == gap.get(p, 0)


def test_enrichment_keeps_row_counts(spark):
    t = _t(spark)
    assert enrich.project_enriched(t["project"], t["user"]).count() == t["project"].count()
    assert enrich.worklog_enriched(t["worklog"], t["user"]).count() == t["worklog"].count()
    assert enrich.comment_enriched(t["comment"], t["user"]).count() == t["comment"].count()
    assert enrich.attachment_enriched(t["attachment"], t["user"]).count() == t["attachment"].count()
    with_project = t["issue"].join(t["project"].select("project_id"), "project_id", "left_semi").count()
    assert enrich.issue_enriched(t["issue"], t["project"], t["sprint"], t["user"]).count() == with_project
    assert enrich.issue_with_parent(t["issue"]).count() == t["issue"].count()


def test_cascades_leave_no_dangling_keys(spark):
    t = _t(spark)
    base = {k: t[k] for k in TABLES}
    assert quality.fk_violations(base).count() == 0
    for table, keys in (("project", t["delete_project"]), ("user", t["delete_user"])):
        new, report = changes.delete_cascade(base, table, keys)
        assert report.count() > 0
        assert quality.fk_violations(new).count() == 0
        removed = {r.table_name: r.row_count for r in report.filter(F.col("action") == "deleted").collect()}
        for name in TABLES:
            assert new[name].count() == base[name].count() - removed.get(name, 0)
