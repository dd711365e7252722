from decimal import Decimal

import datetime as dt

from edge_rows import T0, as_dict, base_tables

from issuegrid.operators import reports


def test_h1_issue_hours(spark):
    t = base_tables(spark)
    got = {k: r.total_hours for k, r in as_dict(reports.issue_hours(t["issue"], t["worklog"]), "issue_id").items()}
    assert got == {1: Decimal("7.25"), 2: Decimal("1.25"), 3: Decimal("0.00"), 4: Decimal("999.99")}


def test_h2_project_hours(spark):
    t = base_tables(spark)
    got = as_dict(reports.project_hours(t["project"], t["issue"], t["worklog"]), "project_id")
    assert {k: r.total_hours for k, r in got.items()} == {
        100: Decimal("8.50"), 200: Decimal("999.99"), 300: Decimal("0.00")}


def test_h3_h4_hours_by_user_and_null_user_gap(spark):
    t = base_tables(spark)
    rows = reports.hours_by_user(t["issue"], t["worklog"], t["user"]).collect()
    assert [tuple(r) for r in rows] == [
        (100, 10, "ann", Decimal("3.75")), (100, 11, "Bob", Decimal("0.75")), (200, 11, "Bob", Decimal("999.99"))]
    a2 = as_dict(reports.project_hours(t["project"], t["issue"], t["worklog"]), "project_id")
    gap = a2[100].total_hours - sum(r.total_user_hours for r in rows if r.project_id == 100)
    assert gap == Decimal("4.00")


def test_issue_hours_restricted_to_keys(spark):
    t = base_tables(spark)
    keys = spark.createDataFrame([(2,), (3,), (3,)], "issue_id int")
    got = reports.issue_hours(t["issue"], t["worklog"], keys).collect()
    assert sorted((r.issue_id, r.total_hours) for r in got) == [(2, Decimal("1.25")), (3, Decimal("0.00"))]


def test_user_issue_counts_long_form(spark):
    t = base_tables(spark)
    got = {(r.user_id, r.role): r.issue_count for r in reports.user_issue_counts(t["user"], t["issue"]).collect()}
    assert got[(10, "reporter")] == 2 and got[(11, "reporter")] == 2
    assert got[(10, "assignee")] == 1 and got[(11, "assignee")] == 1
    assert got[(12, "reporter")] == 0 and got[(12, "assignee")] == 0
    assert len(got) == 6


def test_child_counts_and_sum_invariant(spark):
    t = base_tables(spark)
    got = as_dict(reports.issue_child_counts(t["issue"], t["comment"], t["worklog"], t["attachment"]), "issue_id")
    assert (got[1].comment_count, got[1].worklog_count, got[1].attachment_count) == (1, 3, 1)
    assert (got[3].comment_count, got[3].worklog_count, got[3].attachment_count) == (0, 0, 0)
    a1 = reports.issue_hours(t["issue"], t["worklog"]).collect()
    a2 = reports.project_hours(t["project"], t["issue"], t["worklog"]).collect()
    assert sum(r.total_hours for r in a1) == sum(r.total_hours for r in a2)


def test_last_activity_and_hours_delta(spark):
    t = base_tables(spark)
    events = spark.createDataFrame([
        (1, dt.datetime(2025, 2, 1), 10, 1, "comment_insert", None),
        (2, dt.datetime(2025, 3, 1), 10, 1, "worklog_update", Decimal("1.00")),   # does not touch
        (3, dt.datetime(2025, 2, 2), 10, 3, "worklog_insert", Decimal("2.00")),
        (4, dt.datetime(2025, 2, 3), 10, 3, "worklog_delete", Decimal("0.50")),
    ], "event_id long, ts timestamp, user_id int, issue_id int, kind string, hours decimal(5,2)")
    last = as_dict(reports.issue_last_activity(t["issue"], events), "issue_id")
    assert last[1].last_activity == dt.datetime(2025, 2, 1)
    assert last[2].last_activity == T0
    assert last[3].last_activity == dt.datetime(2025, 2, 2)
    totals = reports.issue_hours(t["issue"], t["worklog"])
    new = as_dict(reports.hours_delta(totals, events), "issue_id")
    assert new[3].total_hours == Decimal("1.50") and new[1].total_hours == Decimal("7.25")


def test_project_report_long_form(spark):
    t = base_tables(spark)
    rep = reports.project_report(t["project"], t["sprint"], t["issue"], t["worklog"], t["user"]).collect()
    by_project = {}
    for r in rep:
        by_project.setdefault(r.project_id, []).append(r)
    assert sorted(r.user_id for r in by_project[100]) == [10, 11]
    assert [r.user_id for r in by_project[300]] == [None] and by_project[300][0].issue_count == 0
    assert by_project[100][0].sprint_count == 1 and by_project[100][0].total_hours == Decimal("8.50")


def test_counts_restricted_to_keys(spark):
    t = base_tables(spark)
    users = spark.createDataFrame([(10,)], "user_id int")
    assert {(r.role, r.issue_count) for r in reports.user_issue_counts(t["user"], t["issue"], users).collect()} == {
        ("reporter", 2), ("assignee", 1)}
    projects = spark.createDataFrame([(300,)], "project_id int")
    assert [tuple(r) for r in reports.project_issue_counts(t["project"], t["issue"], projects).collect()] == [(300, 0)]
    issues = spark.createDataFrame([(4,)], "issue_id int")
    got = reports.issue_child_counts(t["issue"], t["comment"], t["worklog"], t["attachment"], issues).collect()
    assert [tuple(r) for r in got] == [(4, 1, 1, 0)]


def test_j7_inner_joins_drop_unknown_users(spark):
    from issuegrid.operators import enrich
    t = base_tables(spark)
    rows = enrich.worklog_with_user_and_project(t["worklog"], t["user"], t["issue"]).collect()
    assert sorted((r.worklog_id, r.username, r.project_id) for r in rows) == [
        (1, "ann", 100), (2, "Bob", 100), (4, "ann", 100), (5, "Bob", 200)]
