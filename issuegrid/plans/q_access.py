"""Registered queries for visibility and rights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access
from .catalog import query


@query("can_read_issue")
def can_read_issue(t):
    """G1: (user, issue) read grants from project ownership; admins by flag."""
    return access.can_read_issue(t["project"], t["issue"])


@query("can_write_issue")
def can_write_issue(t):
    """(user, issue) write grants: owner, reporter or assignee."""
    return access.can_write_issue(t["project"], t["issue"])


@query("can_assign")
def can_assign(t):
    """(user, issue) assignment grants: project owner."""
    return access.can_assign(t["project"], t["issue"])


@query("can_edit_entry")
def can_edit_entry(t):
    """Comments and worklogs their authors may edit."""
    return access.can_edit_entry(t["comment"], t["worklog"])


@query("can_delete_entry")
def can_delete_entry(t):
    """Comments, worklogs, attachments deletable by author or project owner."""
    return access.can_delete_entry(t["project"], t["issue"], t["comment"], t["worklog"], t["attachment"])


@query("can_edit_project")
def can_edit_project(t):
    """Projects (and their sprints) each owner may edit."""
    return access.can_edit_project(t["project"])


@query("admin_users")
def admin_users(t):
    """G1–G6 admin flag: the users every right holds for."""
    return access.admin_users(t["user"])


@query("assignable_users")
def assignable_users(t):
    """Assignee choices for every (user, project) seen in the activity batch."""
    visits = (t["activity"].join(t["issue"].select("issue_id", "project_id"), "issue_id", "inner")
              .select(F.col("user_id").alias("viewer_id"), "project_id"))
    return access.assignable_users(visits, t["project"])


@query("visible_issues")
def visible_issues(t):
    """G1 as a filter: the issues the owner of the most projects may read."""
    from .q_pages import busiest
    viewer = busiest(t["project"].filter(F.col("owner_id").isNotNull()), "owner_id")
    return access.visible_issues(t["issue"], t["project"], t["user"], viewer)


@query("visible_users")
def visible_users(t):
    """The user list as the first admin sees it (all users, public columns)."""
    viewer = t["user"].filter(F.col("role") == access.ADMIN).select(F.min("user_id")).scalar()
    return access.visible_users(t["user"], viewer)


@query("public_users")
def public_users(t):
    """F7+F8: every user without the password hash, as an explicit column list."""
    from ..operators.lookup import public_user_columns, select_columns

    return select_columns(public_user_columns(t["user"]), ["user_id", "username", "email", "first_name", "last_name", "phone", "role"])


@query("visible_projects")
def visible_projects(t):
    """The project list that every signed-in user sees."""
    return access.visible_projects(t["project"]).select("project_id", "project_key", "project_name", "status", "owner_id")


@query("visible_users_self")
def visible_users_self(t):
    """The user list as a plain user sees it (the own row)."""
    viewer = t["user"].filter(F.col("role") == "user").select(F.min("user_id")).scalar()
    return access.visible_users(t["user"], viewer).select("user_id", "username", "role")
