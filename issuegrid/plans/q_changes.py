"""Registered queries for set-based changes (D1–D10) over the stand-in change batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changelog, changes, sequence
from ..operators.maintain import saved
from .catalog import query

NOW = changes.DEFAULT_NOW
TABLES = ("user", "project", "sprint", "issue", "comment", "attachment", "worklog")


def _base(t):
    return {k: t[k] for k in TABLES}


def _both(ok, bad, pk, cols):
    """Accepted requests with their id and refused ones with their reasons, in one table."""
    return (ok.select(*cols, F.col(pk).cast("long").alias(pk), F.lit(True).alias("accepted"), F.lit("").alias("reasons"))
            .unionByName(bad.select(*cols, F.lit(None).cast("long").alias(pk), F.lit(False).alias("accepted"),
                                    F.array_join("reasons", ",").alias("reasons"))))


@query("insert_rows")
def insert_rows(t):
    """D1+D2+D10: the logged-work requests of the activity batch become worklogs:
    defaults applied, rows checked (hours rules, known issue and user), accepted
    rows numbered after the largest worklog id in request order."""
    ok, bad = changes.insert_rows("worklog", t["new_worklog"], _base(t), NOW, acting_user="user_id")
    hours = F.col("hours_logged").cast(changes.RAW_HOURS).alias("hours_logged")
    return _both(ok, bad, "worklog_id", ["request_id", "issue_id", "user_id", hours, "work_date", "created_at"])


@query("insert_issues")
def insert_issues(t):
    """D1+D2: new issues: forced status, defaults, row rules, known parents, sprint and
    parent in the issue's project."""
    ok, bad = changes.insert_rows("issue", t["new_issue"], _base(t), NOW)
    return _both(ok, bad, "issue_id", ["request_id", "project_id", "sprint_id", "parent_issue_id", "description", "issue_type",
                                       "priority", "status", "story_points", "reporter_id", "assignee_id", "created_date"])


@query("insert_users")
def insert_users(t):
    """D1+D2+D10: the sign-up batch: forced role, row rules, unique names and emails."""
    ok, bad = changes.insert_rows("user", t["new_user"], _base(t), NOW)
    return _both(ok, bad, "user_id", ["request_id", "username", "email", "role", "created_at"])


@query("insert_sprints")
def insert_sprints(t):
    """D1+D2: new sprints: default status, row rules, known projects."""
    ok, bad = changes.insert_rows("sprint", t["new_sprint"], _base(t), NOW)
    return _both(ok, bad, "sprint_id", ["request_id", "project_id", "sprint_name", "goal", "start_date", "end_date", "status", "created_at"])


@query("insert_projects")
def insert_projects(t):
    """D1+D2+D10: new projects: forced status and dates, row rules, known owners, unique keys."""
    ok, bad = changes.insert_rows("project", t["new_project"], _base(t), NOW)
    return _both(ok, bad, "project_id", ["request_id", "project_key", "project_name", "description", "start_date", "end_date", "status", "owner_id", "created_at"])


def _after_delete(t):
    """Sequences before a delete of the last issues (their comments go with them), and the inserts after it."""
    known = sequence.sequences(_base(t))
    left, _ = changes.delete_cascade(_base(t), "issue", t["late_issue"])
    ok, _ = changes.insert_rows("comment", t["new_comment"], left, NOW, sequences=known)
    return known, ok


@query("insert_after_delete")
def insert_after_delete(t):
    """Comments inserted after the last ones were deleted: no id is given out twice."""
    _, ok = _after_delete(t)
    return ok.select("request_id", "comment_id")


@query("stored_sequences")
def stored_sequences(t):
    """The stored sequences after that delete and insert."""
    known, ok = _after_delete(t)
    return sequence.advanced(known, "comment", ok)


@query("insert_comments")
def insert_comments(t):
    """D1+D2: the new comments of the activity batch."""
    ok, bad = changes.insert_rows("comment", t["new_comment"], _base(t), NOW)
    return _both(ok, bad, "comment_id", ["request_id", "issue_id", "user_id", "comment_text", "created_at"])


@query("assign_ids")
def assign_ids(t):
    """Ids for the new comments of the activity batch, after the largest
    comment id, in request order."""
    req = t["new_comment"].select("request_id", "issue_id")
    out = changes.assign_ids(req, "comment_id", ["request_id"], changes.max_id(t["comment"], "comment_id"))
    return out.select("request_id", "comment_id")


@query("apply_status_changes")
def apply_status_changes(t):
    """The status-change batch applied to all issues."""
    new, _ = changes.apply_status_changes(t["issue"], t["status_change"], NOW)
    return new.select("issue_id", "status", "updated_date")


@query("apply_assignments")
def apply_assignments(t):
    """The assignee-change batch applied to all issues."""
    new, _ = changes.apply_assignments(t["issue"], t["user"], t["assignment"], NOW)
    return new.select("issue_id", "assignee_id", "updated_date")


@query("apply_sprint_requests")
def apply_sprint_requests(t):
    """Outcome of every sprint request."""
    _, outcomes = changes.apply_sprint_requests(t["issue"], t["sprint"], t["sprint_request"], NOW)
    return outcomes


@query("apply_sprint_requests_issues")
def apply_sprint_requests_issues(t):
    """The accepted sprint requests applied to all issues."""
    new, _ = changes.apply_sprint_requests(t["issue"], t["sprint"], t["sprint_request"], NOW)
    return new.select("issue_id", "sprint_id", "updated_date")


@query("apply_patches")
def apply_patches(t):
    """D3+D8: the issue patch batch applied to all issues (allow-listed fields only)."""
    new, _ = changes.apply_patches("issue", t["issue"], t["issue_patch"], NOW, parents=_base(t))
    return new.select("issue_id", "description", "issue_type", "priority", "due_date", "story_points",
                      "parent_issue_id", "status", "assignee_id", "sprint_id", "updated_date")


@query("apply_patches_rejected")
def apply_patches_rejected(t):
    """D3: the refused issue patches with their reasons."""
    _, bad = changes.apply_patches("issue", t["issue"], t["issue_patch"], NOW, parents=_base(t))
    return bad.select("change_id", "pk", F.array_join("reasons", ",").alias("reasons"))


@query("apply_status_changes_rejected")
def apply_status_changes_rejected(t):
    """The refused status changes."""
    _, bad = changes.apply_status_changes(t["issue"], t["status_change"], NOW)
    return bad.select("change_id", "issue_id", "status", "reason")


@query("apply_assignments_rejected")
def apply_assignments_rejected(t):
    """The refused assignee changes."""
    _, bad = changes.apply_assignments(t["issue"], t["user"], t["assignment"], NOW)
    return bad.select("change_id", "issue_id", "assignee_id", "reason")


@query("delete_project_cascade_issues")
def delete_project_cascade_issues(t):
    """The issues left after deleting every archived project, with their references."""
    new, _ = changes.delete_cascade(_base(t), "project", t["delete_project"])
    return new["issue"].select("issue_id", "project_id", "sprint_id", "parent_issue_id")


@query("delete_user_setnull_issues")
def delete_user_setnull_issues(t):
    """All issues after deleting the project managers, with their references."""
    new, _ = changes.delete_cascade(_base(t), "user", t["delete_user"])
    return new["issue"].select("issue_id", "reporter_id", "assignee_id", "parent_issue_id")


@query("delete_project_cascade")
def delete_project_cascade(t):
    """Delete every archived project; rows removed and references cleared per table."""
    _, report = changes.delete_cascade(_base(t), "project", t["delete_project"])
    return report


@query("delete_user_setnull")
def delete_user_setnull(t):
    """Delete every project-manager user; references cleared per table."""
    _, report = changes.delete_cascade(_base(t), "user", t["delete_user"])
    return report


@query("issue_touch")
def issue_touch(t):
    """The activity batch replayed on all issues' updated_date."""
    return changes.issue_touch(t["issue"], t["activity"]).select("issue_id", "updated_date")


@query("reject_duplicates")
def reject_duplicates(t):
    """Sign-up batch checked for taken usernames and emails."""
    out = changes.reject_duplicates("user", t["user"], t["new_user"])
    return out.select("request_id", "accepted", F.array_join("reasons", ",").alias("reasons"))


def _delete(table):
    def fn(t):
        _, report = changes.delete_cascade(_base(t), table, t["some_key"])
        return report
    fn.__doc__ = f"D7: delete some {table} rows; rows removed and references cleared per table."
    return fn


for _table in ("sprint", "issue", "comment", "attachment", "worklog"):
    query(f"delete_{_table}")(_delete(_table))


@query("comment_edit_touch")
def comment_edit_touch(t):
    """Issues after a comment snapshot in which some texts changed (some only in letter
    case, which touches nothing) and some comments are new."""
    old = t["comment"].filter(F.col("comment_id") % 5 != 0)
    text = (F.when(F.col("comment_id") % 3 == 0, F.concat("comment_text", F.lit(" (edited)")))
            .when(F.col("comment_id") % 3 == 1, F.upper("comment_text")).otherwise(F.col("comment_text")))
    events = changes.comment_edit_events(old, t["comment"].withColumn("comment_text", text), NOW)
    return changes.issue_touch(t["issue"], events).select("issue_id", "updated_date")


# D3 for the other tables: the fields that the patch views carry.
PATCHED = {"user": ["email", "first_name", "last_name", "phone"], "project": ["project_name", "description", "end_date", "status", "owner_id"],
           "sprint": ["sprint_name", "goal", "status"], "worklog": ["hours_logged", "work_date", "description"], "comment": ["comment_text"]}
MOVED = {"project": ["updated_at"], "sprint": ["updated_at"], "comment": ["updated_at"]}


def _patched(table, rejected):
    def fn(t):
        new, bad = changes.apply_patches(table, t[table], t[f"{table}_patch"], NOW, parents=_base(t))
        if rejected:
            return bad.select("change_id", "pk", F.array_join("reasons", ",").alias("reasons"))
        return new.select(f"{table}_id", *PATCHED[table], *MOVED.get(table, []))
    fn.__doc__ = f"D3+D8: {table} patches" + (": the refused ones with their reasons." if rejected else " applied to all rows.")
    return fn


for _table in PATCHED:
    query(f"patch_{_table}s")(_patched(_table, False))
    query(f"patch_{_table}s_rejected")(_patched(_table, True))


def _logged(t):
    # Statuses of the log are those of issues; its sprints take the default.
    log = t["change_log"].withColumn("status", F.when(F.col("table_name") == "issue", F.col("status")))
    tables = _base(t)
    tables["worklog"] = saved(tables["worklog"])           # numbered by a window; several steps read it
    return changelog.apply_log(tables, log)


@query("change_log_issues")
def change_log_issues(t):
    """D1 with D3 to D9: all issues after a mixed change log."""
    return _logged(t)[0]["issue"].select("issue_id", "project_id", "sprint_id", "parent_issue_id", "description", "status", "reporter_id", "assignee_id",
                                         "story_points", "updated_date")


@query("change_log_comments")
def change_log_comments(t):
    """D1 with D3 to D9: all comments after a mixed change log."""
    return _logged(t)[0]["comment"].select("comment_id", "issue_id", "user_id", "comment_text", "updated_at")


@query("change_log_worklogs")
def change_log_worklogs(t):
    """D1 with D3 to D9: all worklogs after a mixed change log."""
    return _logged(t)[0]["worklog"].select("worklog_id", "issue_id", "user_id", "hours_logged", "work_date")


@query("change_log_refused")
def change_log_refused(t):
    """D1 with D3 to D9: the refused changes of a mixed log with their reasons."""
    return _logged(t)[1].select("change_id", "table_name", "action", "pk", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))
