"""Registered queries for paging (P1–P9) and the issue document."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import details, enrich, pagedir, paging
from ..session import checkpoint_dir
from .catalog import query

def busiest(df, key: str):
    """The ``key`` value with the most rows (ties: the smallest), as a scalar
    subquery — each page query pages its hottest parent."""
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), key).limit(1)
    return top.select(key).scalar()


@query("page_users")
def page_users(t):
    """Second page of users by id."""
    return paging.page_users(t["user"], skip=100, limit=100)


@query("page_projects")
def page_projects(t):
    """First page of projects, newest first, with owner names."""
    return paging.page_projects(t["project"], t["user"], skip=0, limit=100)


@query("page_project_sprints")
def page_project_sprints(t):
    """Sprints of the project with most sprints, by start date (nulls last), then creation."""
    return paging.page_project_sprints(t["sprint"], busiest(t["sprint"], "project_id"), 0, 100)


@query("page_project_issues")
def page_project_issues(t):
    """Second page of the busiest project's issues, newest first."""
    return paging.page_project_issues(t["issue"], t["project"], t["sprint"], t["user"],
                                      busiest(t["issue"], "project_id"), 100, 100)


@query("page_project_issues_keyset")
def page_project_issues_keyset(t):
    """P4 by keyset: the busiest project's second page of 100, fetched after the
    cursor of row 100 instead of skipping rows (same rows as the offset page)."""
    pid = busiest(t["issue"], "project_id")
    base = t["issue"].filter(F.col("project_id") == pid).join(t["project"].select("project_id"), "project_id",
                                                               "left_semi")
    order = paging.ORDERS["project_issues"]
    rows = paging.page_after(base, order, paging.cursor_of(base, order, 100), 100)
    return enrich.issue_enriched(rows, t["project"], t["sprint"], t["user"]).orderBy(*paging.sort_columns(order))


@query("page_sprint_issues")
def page_sprint_issues(t):
    """P5: first page of the busiest sprint's issues, priority in alphabetical order."""
    return paging.page_sprint_issues(t["issue"], t["project"], t["sprint"], t["user"],
                                     busiest(t["issue"].filter(F.col("sprint_id").isNotNull()), "sprint_id"), 0, 100)


@query("page_issue_comments")
def page_issue_comments(t):
    """Comments of the most-commented issue, oldest first."""
    return paging.page_issue_comments(t["comment"], t["user"], busiest(t["comment"], "issue_id"), 0, 100)


@query("page_issue_worklogs")
def page_issue_worklogs(t):
    """Worklogs of the issue with most worklogs, latest work date first."""
    return paging.page_issue_worklogs(t["worklog"], t["user"], busiest(t["worklog"], "issue_id"), 0, 100)


@query("page_issue_attachments")
def page_issue_attachments(t):
    """Attachments of the issue with most attachments, newest first."""
    return paging.page_issue_attachments(t["attachment"], t["user"], busiest(t["attachment"], "issue_id"), 0, 100)


@query("top_k_per_parent")
def top_k_per_parent(t):
    """The 100 newest issues of every project, ranked."""
    return paging.top_k_per_parent(t["issue"], "project_id", paging.ORDERS["project_issues"], 0, 100)


@query("issue_details")
def issue_details(t):
    """Documents of all issues (first 100 of each child list), flat form."""
    doc = details.issue_details(t["issue"], t["project"], t["sprint"], t["user"], t["comment"],
                                t["worklog"], t["attachment"])
    return details.explode_details(doc)


def _deep(rows, kind, parent):
    """The page in the middle of the list of the parent with most rows, by a page directory."""
    spark = rows.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"pages-{kind}-{uuid.uuid4().hex[:12]}")
    pages = pagedir.build(rows, paging.ORDERS[kind], path, parent)
    hottest = rows.groupBy(parent).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), parent).first()[0]
    return pages.page(spark, hottest, skip=pages.rows_of(spark, hottest) // 2, limit=100)


@query("page_project_issues_deep")
def page_project_issues_deep(t):
    """P4 at depth: the busiest project's page that starts in the middle of its issues."""
    issues = t["issue"].join(t["project"].select("project_id"), "project_id", "left_semi").select(*t["issue"].columns)
    rows = _deep(issues, "project_issues", "project_id")
    return enrich.issue_enriched(rows, t["project"], t["sprint"], t["user"]).orderBy(*paging.sort_columns(paging.ORDERS["project_issues"]))


@query("page_issue_worklogs_deep")
def page_issue_worklogs_deep(t):
    """P7 at depth: the page in the middle of the busiest issue's worklogs."""
    cols = ["worklog_id", "issue_id", "user_id", "hours_logged", "work_date", "created_at"]
    return _deep(t["worklog"].select(*cols), "worklogs", "issue_id").select(*cols[:-1])
