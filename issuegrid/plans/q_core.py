"""Registered queries for sources, lookups, joins and reports (S, F, J, A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, lookup, reports
from .catalog import query


@query("hours_by_user")
def hours_by_user(t):
    """A3: hours per (project, user) over all worklogs with a known user."""
    return reports.hours_by_user(t["issue"], t["worklog"], t["user"])


@query("issue_hours")
def issue_hours(t):
    """A1: total hours per issue, zero-filled."""
    return reports.issue_hours(t["issue"], t["worklog"])


@query("project_hours")
def project_hours(t):
    """A2: total hours per project, including worklogs without a user."""
    return reports.project_hours(t["project"], t["issue"], t["worklog"])


@query("user_issue_counts")
def user_issue_counts(t):
    """A4: issues per user as reporter and as assignee (long form, zero-filled)."""
    return reports.user_issue_counts(t["user"], t["issue"])


@query("project_issue_counts")
def project_issue_counts(t):
    """A5: issues per project, zero-filled."""
    return reports.project_issue_counts(t["project"], t["issue"])


@query("issue_child_counts")
def issue_child_counts(t):
    """Comments, worklogs and attachments per issue, uncapped."""
    return reports.issue_child_counts(t["issue"], t["comment"], t["worklog"], t["attachment"])


@query("issue_last_activity")
def issue_last_activity(t):
    """Newest of updated_date and every touching row (comment insert/edit,
    worklog insert, attachment insert) per issue."""
    events = reports.touch_events(t["comment"], t["worklog"], t["attachment"])
    return reports.issue_last_activity(t["issue"], events)


@query("hours_delta")
def hours_delta(t):
    """Per-issue totals (A1) moved by the signed worklog events of the activity batch."""
    totals = reports.issue_hours(t["issue"], t["worklog"])
    return reports.hours_delta(totals, t["activity"])


@query("project_report")
def project_report(t):
    """Project page figures joined to per-user hours (long form)."""
    return reports.project_report(t["project"], t["sprint"], t["issue"], t["worklog"], t["user"])


@query("project_enriched")
def project_enriched(t):
    """Projects with owner username."""
    return enrich.project_enriched(t["project"], t["user"])


@query("issue_enriched")
def issue_enriched(t):
    """Issues with project key, sprint name, reporter and assignee names."""
    return _issues(t)


@query("worklog_enriched")
def worklog_enriched(t):
    """Worklogs with logger username."""
    return enrich.worklog_enriched(t["worklog"], t["user"])


@query("comment_enriched")
def comment_enriched(t):
    """Comments with author username."""
    return enrich.comment_enriched(t["comment"], t["user"])


@query("attachment_enriched")
def attachment_enriched(t):
    """Attachments with uploader username."""
    return enrich.attachment_enriched(t["attachment"], t["user"])


@query("issue_with_parent")
def issue_with_parent(t):
    """Issues with the parent's description."""
    return enrich.issue_with_parent(t["issue"])


@query("exists_checks")
def exists_checks(t):
    """EXISTS checks of issue creation, per issue."""
    return lookup.exists_checks(t["issue"], t["project"], t["sprint"])


@query("lookup_by_keys")
def lookup_by_keys(t):
    """enriched issues for every issue id named in the sprint-request batch."""
    return lookup.lookup_by_keys(_issues(t), t["sprint_request"].select("issue_id"), "issue_id")


@query("lookup_by_natural_key")
def lookup_by_natural_key(t):
    """users found by upper-cased sign-up names, compared case-insensitively."""
    keys = t["new_user"].select(F.upper("username").alias("key"))
    users = t["user"].select("user_id", "username", "email", "role")
    return lookup.lookup_by_natural_key(users, keys, "username")


@query("children_of_parent")
def children_of_parent(t):
    """worklogs of every blocked issue."""
    parents = t["issue"].filter(F.col("status") == "Blocked")
    w = t["worklog"].select("worklog_id", "issue_id", "user_id", "hours_logged", "work_date")
    return lookup.children_of(w, "issue_id", parents, "issue_id")


@query("issue_filter")
def issue_filter(t):
    """issue listing asked with the busiest project and sprint 0 (0 = not
    given, so the project filter applies)."""
    from .q_pages import busiest
    return lookup.issue_filter(_issues(t), project_id=busiest(t["issue"], "project_id"), sprint_id=0)


@query("backlog")
def backlog(t):
    """enriched issues without a sprint."""
    return lookup.backlog(_issues(t))


def _issues(t):
    return enrich.issue_enriched(t["issue"], t["project"], t["sprint"], t["user"])


# F1 for the other tables: a few columns of the rows whose id is asked for.
LOOKED_UP = {"user": ["user_id", "username", "role"], "project": ["project_id", "project_key", "status"],
             "sprint": ["sprint_id", "project_id", "sprint_name"], "comment": ["comment_id", "issue_id", "comment_text"],
             "attachment": ["attachment_id", "issue_id", "file_name"], "worklog": ["worklog_id", "issue_id", "hours_logged"]}
CHILDREN = {"comment": "issue_id", "attachment": "issue_id", "sprint": "project_id", "issue": "project_id"}


def _lookup(table, cols):
    def fn(t):
        return lookup.lookup_by_keys(t[table].select(*cols), t["some_key"], cols[0])
    fn.__doc__ = f"F1: {table} rows by id."
    return fn


for _table, _cols in LOOKED_UP.items():
    query(f"lookup_{_table}_by_keys")(_lookup(_table, _cols))


def _children(table, parent):
    def fn(t):
        rows = t[table].select(f"{table}_id", parent)
        return lookup.children_of(rows, parent, t["some_key"], "pk")
    fn.__doc__ = f"F3: {table} rows of the parents asked for."
    return fn


for _table, _parent in CHILDREN.items():
    query(f"{_table}s_of_parents")(_children(_table, _parent))


@query("worklog_with_user_and_project")
def worklog_with_user_and_project(t):
    """Worklogs with their user's name and their issue's project."""
    return enrich.worklog_with_user_and_project(t["worklog"], t["user"], t["issue"]).select(
        "worklog_id", "user_id", "username", "project_id", "hours_logged")
