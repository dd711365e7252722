"""Oracle bodies for reports and checks kept up to date: the full recomputation over the
tables after the change."""

import re

from .o_core import HOURS_BY_USER
from .o_quality import FK_VIOLATIONS, PARENT_MISMATCH, PK
from .oracle import BODIES, sql
from .q_maintain import LATER, MOVED


def _over(prefix, body):
    return re.sub(rf"\bt_({'|'.join(PK)})\b", rf"{prefix}_\1", body)


AFTER_BATCHES = f"""
n_user AS (SELECT * FROM t_user),
n_project AS (SELECT * FROM t_project WHERE project_id NOT IN (SELECT pk FROM t_delete_project)),
n_sprint AS (SELECT * FROM t_sprint WHERE project_id IN (SELECT project_id FROM n_project)),
n_issue AS (SELECT * FROM t_issue WHERE project_id IN (SELECT project_id FROM n_project)),
n_worklog AS (
  SELECT * FROM (
    SELECT w.worklog_id, w.issue_id, w.user_id, p.hours_logged, w.created_at
    FROM t_worklog w JOIN ({BODIES['patch_worklogs']}) p ON p.worklog_id = w.worklog_id
    UNION ALL SELECT worklog_id, issue_id, user_id, CAST(hours_logged AS DECIMAL(5,2)), created_at FROM ({BODIES['insert_rows']}) a WHERE accepted) x
  WHERE issue_id IN (SELECT issue_id FROM n_issue)),
n_comment AS (
  SELECT * FROM (
    SELECT comment_id, issue_id, created_at, updated_at FROM t_comment
    UNION ALL SELECT comment_id, issue_id, created_at, CAST(NULL AS TIMESTAMP) FROM ({BODIES['insert_comments']}) a WHERE accepted) x
  WHERE issue_id IN (SELECT issue_id FROM n_issue) AND comment_id NOT IN (SELECT pk FROM t_some_key)),
n_attachment AS (SELECT * FROM t_attachment WHERE issue_id IN (SELECT issue_id FROM n_issue))"""

for _name, _body in {
        "issue_hours": BODIES["issue_hours"], "project_hours": BODIES["project_hours"], "hours_by_user": HOURS_BY_USER,
        "user_issue_counts": BODIES["user_issue_counts"], "project_issue_counts": BODIES["project_issue_counts"],
        "child_counts": BODIES["issue_child_counts"], "last_activity": BODIES["issue_last_activity"],
        "project_report": BODIES["project_report"]}.items():
    sql(f"maintained_{_name}", f"WITH {AFTER_BATCHES}\n{_over('n', _body)}")


def _later(table):
    columns = f"* REPLACE ({MOVED[table][1]} AS {MOVED[table][0]})" if table in MOVED else "*"
    return f"n_{table} AS (SELECT {columns} FROM t_dirty_{table}{' WHERE ' + LATER[table] if table in LATER else ''})"


SPRINT_MISMATCH = """
SELECT i.issue_id, i.sprint_id, i.project_id AS issue_project_id, s.project_id AS sprint_project_id
FROM t_issue i JOIN t_sprint s ON s.sprint_id = i.sprint_id WHERE s.project_id <> i.project_id"""

for _name, _body in {"fk_violations": FK_VIOLATIONS, "parent_mismatch": PARENT_MISMATCH, "sprint_mismatch": SPRINT_MISMATCH}.items():
    sql(f"maintained_{_name}", f"WITH {', '.join(_later(t) for t in PK)}\n{_over('n', _body)}")
