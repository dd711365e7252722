"""Hand-made edge rows (the small base of users, projects, issues and worklogs)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from issuegrid.schema import SCHEMAS

T0 = dt.datetime(2025, 1, 1, 9, 0, 0)


def table(spark, name, rows):
    """Rows given as dicts; missing columns are null."""
    schema = SCHEMAS[name]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def base_tables(spark):
    users = table(spark, "user", [
        dict(user_id=10, username="ann", email="ann@x.org", password_hash="h", role="user", created_at=T0),
        dict(user_id=11, username="Bob", email="bob@x.org", password_hash="h", role="user", created_at=T0),
        dict(user_id=12, username="idle", email="idle@x.org", password_hash="h", role="admin", created_at=T0),
    ])
    projects = table(spark, "project", [
        dict(project_id=100, project_key="AAA", project_name="A", status="active", owner_id=10,
             created_at=T0, updated_at=T0),
        dict(project_id=200, project_key="BBB", project_name="B", status="active", owner_id=11,
             created_at=T0, updated_at=T0),
        dict(project_id=300, project_key="CCC", project_name="C", status="planning", owner_id=None,
             created_at=T0, updated_at=T0),
    ])
    sprints = table(spark, "sprint", [
        dict(sprint_id=1, project_id=100, sprint_name="S1", status="active", created_at=T0, updated_at=T0),
        dict(sprint_id=2, project_id=200, sprint_name="S2", status="future", created_at=T0, updated_at=T0),
    ])
    issues = table(spark, "issue", [
        dict(issue_id=1, project_id=100, sprint_id=1, description="one", issue_type="Task", priority="High",
             status="To Do", reporter_id=10, assignee_id=11, created_date=T0, updated_date=T0, story_points=3),
        dict(issue_id=2, project_id=100, description="two", issue_type="Bug", priority="Low", status="Done",
             reporter_id=11, created_date=T0, updated_date=T0, parent_issue_id=1),
        dict(issue_id=3, project_id=100, description="three", issue_type="Story", priority="Medium",
             status="Blocked", reporter_id=10, created_date=T0, updated_date=T0),
        dict(issue_id=4, project_id=200, sprint_id=2, description="four", issue_type="Epic", priority="Highest",
             status="In Review", reporter_id=11, assignee_id=10, created_date=T0, updated_date=T0),
    ])
    worklogs = table(spark, "worklog", [
        dict(worklog_id=1, issue_id=1, user_id=10, hours_logged=Decimal("2.50"), work_date=dt.date(2025, 1, 2),
             created_at=T0),
        dict(worklog_id=2, issue_id=1, user_id=11, hours_logged=Decimal("0.75"), work_date=dt.date(2025, 1, 2),
             created_at=T0),
        dict(worklog_id=3, issue_id=1, user_id=None, hours_logged=Decimal("4.00"), work_date=dt.date(2025, 1, 3),
             created_at=T0),
        dict(worklog_id=4, issue_id=2, user_id=10, hours_logged=Decimal("1.25"), work_date=dt.date(2025, 1, 3),
             created_at=T0),
        dict(worklog_id=5, issue_id=4, user_id=11, hours_logged=Decimal("999.99"), work_date=dt.date(2025, 1, 4),
             created_at=T0),
    ])
    comments = table(spark, "comment", [
        dict(comment_id=1, issue_id=1, user_id=10, comment_text="x", created_at=T0),
        dict(comment_id=2, issue_id=4, user_id=None, comment_text="hello", created_at=T0),
    ])
    attachments = table(spark, "attachment", [
        dict(attachment_id=1, issue_id=1, user_id=11, file_name="a.txt", file_path="u1_a.txt", file_size_bytes=3,
             uploaded_at=T0),
    ])
    return {"user": users, "project": projects, "sprint": sprints, "issue": issues, "worklog": worklogs,
            "comment": comments, "attachment": attachments}


def as_dict(df, key):
    return {r[key]: r for r in df.collect()}
