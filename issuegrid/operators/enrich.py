"""Enriched listings (a table plus names from its parents).

Each function keeps every row of the left table except where noted INNER. The
dimension lookups are plain equi-joins; AQE turns them into broadcast hash joins
when the measured dimension is small and keeps sort-merge otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup

ISSUE_COLUMNS = (
    "issue_id", "project_id", "sprint_id", "description", "issue_type", "priority", "status",
    "reporter_id", "assignee_id", "created_date", "due_date", "updated_date", "story_points",
    "parent_issue_id",
)


def project_enriched(project: DataFrame, user: DataFrame) -> DataFrame:
    """Project + ``owner_username`` (LEFT)."""
    return lookup(project, user, "owner_id", "user_id", {"username": "owner_username"})


def issue_enriched(issue: DataFrame, project: DataFrame, sprint: DataFrame, user: DataFrame) -> DataFrame:
    """Issue + ``project_key`` (INNER) + ``sprint_name`` + reporter/assignee usernames (LEFT).

    An issue whose project is missing is dropped, as the INNER join does.
    """
    base = issue.select(*ISSUE_COLUMNS)
    out = lookup(base, project, "project_id", "project_id", {"project_key": "project_key"}, how="inner")
    out = lookup(out, sprint, "sprint_id", "sprint_id", {"sprint_name": "sprint_name"}, spread_by="issue_id")
    out = lookup(out, user, "reporter_id", "user_id", {"username": "reporter_username"}, spread_by="issue_id")
    out = lookup(out, user, "assignee_id", "user_id", {"username": "assignee_username"}, spread_by="issue_id")
    return out


def worklog_enriched(worklog: DataFrame, user: DataFrame) -> DataFrame:
    """Worklog + ``logger_username`` (LEFT)."""
    return lookup(worklog, user, "user_id", "user_id", {"username": "logger_username"}, spread_by="worklog_id")


def comment_enriched(comment: DataFrame, user: DataFrame) -> DataFrame:
    """Comment + ``author_username`` (LEFT)."""
    return lookup(comment, user, "user_id", "user_id", {"username": "author_username"}, spread_by="comment_id")


def attachment_enriched(attachment: DataFrame, user: DataFrame) -> DataFrame:
    """Attachment + ``uploader_username`` (LEFT)."""
    return lookup(attachment, user, "user_id", "user_id", {"username": "uploader_username"}, spread_by="attachment_id")


def worklog_with_project(worklog: DataFrame, issue: DataFrame) -> DataFrame:
    """Worklog ⋈ issue (INNER) — adds ``project_id`` to each worklog."""
    return worklog.join(issue.select("issue_id", "project_id"), "issue_id", "inner")


def worklog_with_user_and_project(worklog: DataFrame, user: DataFrame, issue: DataFrame) -> DataFrame:
    """Worklog ⋈ user ⋈ issue (INNER ×2). Drops worklogs whose user is null or gone."""
    w = worklog.filter(F.col("user_id").isNotNull())
    w = w.join(user.select("user_id", "username"), "user_id", "inner")
    return worklog_with_project(w, issue)


def issue_with_parent(issue: DataFrame) -> DataFrame:
    """Issue + ``parent_description`` from the same table (LEFT self-join)."""
    parent = issue.select(F.col("issue_id").alias("__pid"), F.col("description").alias("parent_description"))
    child = issue.select(*ISSUE_COLUMNS)
    # Issues without a parent are the common case; spread them like any null key.
    return lookup(child, parent.withColumnRenamed("__pid", "issue_id"), "parent_issue_id", "issue_id",
                  {"parent_description": "parent_description"}, spread_by="issue_id")
