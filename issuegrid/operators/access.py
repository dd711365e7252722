"""G1–G9 (and the access-scope join J10): row visibility and rights as relations.

The reference checks one request ("may user U read issue I?"); here each right
is the relation of ``(user_id, row id)`` pairs it grants, built as a union of
equi-joins — one per clause (project owner, reporter, assignee, author) — and
de-duplicated. The reference's OR test would plan as a nested-loop join; the
union of equi-joins plans as hash joins.

Admins may do everything. Their grants are *not* materialised (that would be
users × all rows); :func:`admin_users` gives the flag and the ``visible_*``
filters apply it for one viewer.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMIN = "admin"


def admin_users(user: DataFrame) -> DataFrame:
    """``(user_id)`` of every admin — the rights that hold for all rows."""
    return user.filter(F.col("role") == ADMIN).select("user_id")


def _owner_of_issue(project: DataFrame, issue: DataFrame) -> DataFrame:
    """The owner clause of the access test as an equi-join (issue → its
    project's owner); the admin clause is the :func:`admin_users` flag."""
    owners = project.filter(F.col("owner_id").isNotNull()).select("project_id", F.col("owner_id").alias("user_id"))
    return issue.select("issue_id", "project_id").join(owners, "project_id", "inner").select("user_id", "issue_id")


def can_read_issue(project: DataFrame, issue: DataFrame) -> DataFrame:
    """G1: ``(user_id, issue_id)`` — the project owner reads the issue and
    everything under it (comments, worklogs, attachments, the sprint)."""
    return _owner_of_issue(project, issue)


def can_write_issue(project: DataFrame, issue: DataFrame) -> DataFrame:
    """``(user_id, issue_id)`` — owner, reporter or assignee may edit the
    issue, change its status or delete it. (A reporter or assignee may write an
    issue they may not read; that is the reference's rule.)

    One pass over the issues: the project owner is attached by an equi-join
    (projects with no owner keep a null), then the three clause columns are
    exploded without repeats (no shuffle: issue ids are unique)."""
    owners = project.select("project_id", F.col("owner_id").alias("__owner"))
    rows = issue.select("issue_id", "project_id", "reporter_id", "assignee_id").join(owners, "project_id", "left")
    users = F.array_distinct(F.array("__owner", "reporter_id", "assignee_id"))     # issue ids are unique
    return rows.select(F.explode(users).alias("user_id"), "issue_id").filter(F.col("user_id").isNotNull())


def can_assign(project: DataFrame, issue: DataFrame) -> DataFrame:
    """``(user_id, issue_id)`` — assigning a user or a sprint needs project
    access: the owner (admins by flag)."""
    return can_read_issue(project, issue)


def _entries(comment: DataFrame | None, worklog: DataFrame | None, attachment: DataFrame | None) -> list[DataFrame]:
    out = []
    for kind, df, key in (("comment", comment, "comment_id"), ("worklog", worklog, "worklog_id"),
                          ("attachment", attachment, "attachment_id")):
        if df is not None:
            out.append(df.select(F.lit(kind).alias("entry_kind"), F.col(key).alias("entry_id"), "issue_id", "user_id"))
    return out


def can_edit_entry(comment: DataFrame, worklog: DataFrame) -> DataFrame:
    """``(user_id, entry_kind, entry_id)`` — only the author edits a comment
    or a worklog."""
    parts = [e.filter(F.col("user_id").isNotNull()).select("user_id", "entry_kind", "entry_id")
             for e in _entries(comment, worklog, None)]
    return functools.reduce(DataFrame.unionByName, parts)


def can_delete_entry(project: DataFrame, issue: DataFrame, comment: DataFrame, worklog: DataFrame,
                     attachment: DataFrame) -> DataFrame:
    """``(user_id, entry_kind, entry_id)`` — the author or the owner of the
    entry's project deletes a comment, worklog or attachment. One pass over the
    entries: the owner is attached by an equi-join on the issue, then author
    and owner are exploded without repeats (no shuffle: ids are unique)."""
    entries = functools.reduce(DataFrame.unionByName, _entries(comment, worklog, attachment))
    owners = _owner_of_issue(project, issue).withColumnRenamed("user_id", "__owner")
    rows = entries.join(owners, "issue_id", "left")
    users = F.array_distinct(F.array("user_id", "__owner"))                        # entry ids are unique
    return rows.select(F.explode(users).alias("user_id"), "entry_kind", "entry_id").filter(F.col("user_id").isNotNull())


def can_edit_project(project: DataFrame) -> DataFrame:
    """``(user_id, project_id)`` — the owner edits or deletes the project and
    creates, edits or deletes its sprints."""
    return project.filter(F.col("owner_id").isNotNull()).select(F.col("owner_id").alias("user_id"), "project_id")


def visible_projects(project: DataFrame) -> DataFrame:
    """Every signed-in user sees every project (and its sprint/issue lists
    under the project route)."""
    return project


def visible_users(user: DataFrame, viewer_id: int | Column) -> DataFrame:
    """The user list for one viewer — all users for an admin, else only the
    viewer's own row. Password hashes are never part of it."""
    viewer_is_admin = user.filter((F.col("user_id") == viewer_id) & (F.col("role") == ADMIN)).exists()
    public = user.drop("password_hash")
    return public.filter(viewer_is_admin | (F.col("user_id") == viewer_id))


def visible_issues(issue: DataFrame, project: DataFrame, user: DataFrame, viewer_id: int | Column) -> DataFrame:
    """G1 as a filter for one viewer: all issues for an admin, else the issues
    of the projects the viewer owns."""
    viewer_is_admin = user.filter((F.col("user_id") == viewer_id) & (F.col("role") == ADMIN)).exists()
    owned = project.filter(F.col("owner_id") == viewer_id).select("project_id", F.lit(True).alias("__owned"))
    return (issue.join(owned, "project_id", "left")
            .filter(viewer_is_admin | F.col("__owned").isNotNull()).drop("__owned"))


def assignable_users(visits: DataFrame, project: DataFrame) -> DataFrame:
    """For each ``(viewer_id, project_id)`` visit, the users offered in the
    assignee list: the viewer and the project owner, without repeats.
    ``(viewer_id, project_id, user_id)``."""
    v = visits.select("viewer_id", "project_id").distinct()
    with_owner = v.join(project.select("project_id", "owner_id"), "project_id", "left")
    users = F.array_distinct(F.array("viewer_id", "owner_id"))
    return (with_owner.select("viewer_id", "project_id", F.explode(users).alias("user_id"))
            .filter(F.col("user_id").isNotNull()))
