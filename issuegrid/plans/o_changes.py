"""Oracle bodies for set-based changes."""

import re

from .o_quality import PK, REASONS
from .oracle import sql

NOW = "TIMESTAMP '2025-01-01 00:00:00'"



def _insert(table, view, cols, keys, out, dup=""):
    """Text of an insert: ``cols`` make the rows, ``keys`` are (column, parent, same project?)."""
    pk, rules = PK[table], "\n".join(x for x in REASONS[table].split("\n") if f"WHEN {PK[table]} IS NULL" not in x)
    refs = []
    for col, parent, same in keys:
        refs.append(f"CASE WHEN {col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t_{parent} p WHERE p.{PK[parent]} = r.{col}) THEN '{col}:unknown_parent' END")
        if same:
            refs.append(f"CASE WHEN EXISTS (SELECT 1 FROM t_{parent} p WHERE p.{PK[parent]} = r.{col} AND p.project_id <> r.project_id) THEN '{col}:other_project' END")
    return f"""
made AS (SELECT request_id, {cols} FROM {view}),
ruled AS (SELECT *, concat_ws(',', NULLIF({rules}, ''){''.join(', ' + x for x in refs)}) AS first_reasons FROM made r),
{dup or 'judged AS (SELECT *, first_reasons AS reasons FROM ruled)'}
SELECT {out}, CASE WHEN reasons = '' THEN CAST((SELECT coalesce(max({pk}), 0) FROM t_{table}) + row_number() OVER (PARTITION BY reasons = '' ORDER BY request_id) AS BIGINT) END AS {pk},
  reasons = '' AS accepted, reasons
FROM judged
"""


sql("insert_rows", "WITH " + _insert(
    "worklog", "t_new_worklog", f"issue_id, user_id, hours_logged, work_date, {NOW} AS created_at", [("issue_id", "issue", False), ("user_id", "user", False)],
    "request_id, issue_id, user_id, CAST(CASE WHEN reasons = '' THEN round_even(hours_logged, 2) ELSE hours_logged END AS DECIMAL(20,6)) AS hours_logged, work_date, created_at"))

sql("insert_issues", "WITH " + _insert(
    "issue", "t_new_issue", f"""project_id, sprint_id, parent_issue_id, description, COALESCE(issue_type, 'Task') AS issue_type, 'Medium' AS priority,
  'To Do' AS status, story_points, reporter_id, assignee_id, {NOW} AS created_date""",
    [("project_id", "project", False), ("sprint_id", "sprint", True), ("reporter_id", "user", False), ("assignee_id", "user", False), ("parent_issue_id", "issue", True)],
    "request_id, project_id, sprint_id, parent_issue_id, description, issue_type, priority, status, story_points, reporter_id, assignee_id, created_date"))

sql("insert_comments", "WITH " + _insert(
    "comment", "t_new_comment", f"issue_id, user_id, comment_text, {NOW} AS created_at", [("issue_id", "issue", False), ("user_id", "user", False)],
    "request_id, issue_id, user_id, comment_text, created_at"))

sql("insert_sprints", "WITH " + _insert(
    "sprint", "t_new_sprint", f"project_id, sprint_name, goal, start_date, end_date, COALESCE(status, 'future') AS status, {NOW} AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at",
    [("project_id", "project", False)], "request_id, project_id, sprint_name, goal, start_date, end_date, status, created_at"))

# A project has one unique key: its first request that keeps the other rules gets it, if no project holds it.
sql("insert_projects", "WITH " + _insert(
    "project", "t_new_project", f"""project_key, project_name, description, CAST(NULL AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date,
  'planning' AS status, owner_id, {NOW} AS created_at""", [("owner_id", "user", False)],
    "request_id, project_key, project_name, description, start_date, end_date, status, owner_id, created_at",
    dup="""judged AS (SELECT *, concat_ws(',', NULLIF(first_reasons, ''), CASE WHEN first_reasons = '' AND (
    EXISTS (SELECT 1 FROM t_project p WHERE lower(p.project_key) = lower(r.project_key))
    OR EXISTS (SELECT 1 FROM ruled e WHERE e.first_reasons = '' AND lower(e.project_key) = lower(r.project_key) AND e.request_id < r.request_id))
    THEN 'project_key:duplicate' END) AS reasons FROM ruled r)"""))

# Ids after the largest one ever given out, though the comments of the last issues are gone.
sql("insert_after_delete", """
SELECT request_id, CAST((SELECT max(comment_id) FROM t_comment) + row_number() OVER (ORDER BY request_id) AS BIGINT) AS comment_id
FROM t_new_comment c WHERE EXISTS (SELECT 1 FROM t_issue i WHERE i.issue_id = c.issue_id AND i.issue_id <= 900) AND EXISTS (SELECT 1 FROM t_user u WHERE u.user_id = c.user_id)
""")
sql("stored_sequences", """
WITH made AS (
  SELECT count(*) AS n FROM t_new_comment c WHERE EXISTS (SELECT 1 FROM t_issue i WHERE i.issue_id = c.issue_id AND i.issue_id <= 900)
    AND EXISTS (SELECT 1 FROM t_user u WHERE u.user_id = c.user_id))
SELECT 'user' AS table_name, CAST(max(user_id) AS BIGINT) AS last_id FROM t_user UNION ALL SELECT 'project', max(project_id) FROM t_project
UNION ALL SELECT 'sprint', max(sprint_id) FROM t_sprint UNION ALL SELECT 'issue', max(issue_id) FROM t_issue
UNION ALL SELECT 'comment', max(comment_id) + (SELECT n FROM made) FROM t_comment
UNION ALL SELECT 'attachment', max(attachment_id) FROM t_attachment UNION ALL SELECT 'worklog', max(worklog_id) FROM t_worklog
""")


def _one_by_one(source):
    """CTEs that take the rows of ``source`` in request order: a row is accepted when neither
    its name nor its email is held by a user or by an accepted row before it. Rows whose
    name and email nobody else in the batch wants need no turn. Ends with ``held_names``
    and ``held_emails`` (key, request that holds it)."""
    return f"""
asked AS (SELECT request_id, lower(username) AS u, lower(email) AS e FROM {source}),
free AS (SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM t_user x WHERE lower(x.username) = a.u) AND NOT EXISTS (SELECT 1 FROM t_user x WHERE lower(x.email) = a.e)),
wanted AS (SELECT *, count(*) OVER (PARTITION BY u) > 1 OR count(*) OVER (PARTITION BY e) > 1 AS more FROM free),
turns AS (SELECT request_id, u, e, row_number() OVER (ORDER BY request_id) AS k FROM wanted WHERE more),
step AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS es, CAST(NULL AS BIGINT) AS request_id, false AS ok
  UNION ALL
  SELECT t.k, CASE WHEN list_contains(s.us, t.u) OR list_contains(s.es, t.e) THEN s.us ELSE list_append(s.us, t.u) END,
    CASE WHEN list_contains(s.us, t.u) OR list_contains(s.es, t.e) THEN s.es ELSE list_append(s.es, t.e) END,
    t.request_id, NOT (list_contains(s.us, t.u) OR list_contains(s.es, t.e))
  FROM step s JOIN turns t ON t.k = s.k + 1),
taken AS (SELECT request_id, u, e FROM turns WHERE request_id IN (SELECT request_id FROM step WHERE ok) UNION ALL SELECT request_id, u, e FROM wanted WHERE NOT more),
duplicates AS (
  SELECT a.request_id, concat_ws(',',
    CASE WHEN EXISTS (SELECT 1 FROM t_user x WHERE lower(x.username) = a.u) OR EXISTS (SELECT 1 FROM taken y WHERE y.u = a.u AND y.request_id < a.request_id) THEN 'username:duplicate' END,
    CASE WHEN EXISTS (SELECT 1 FROM t_user x WHERE lower(x.email) = a.e) OR EXISTS (SELECT 1 FROM taken y WHERE y.e = a.e AND y.request_id < a.request_id) THEN 'email:duplicate' END) AS dup
  FROM asked a)"""


sql("insert_users", "WITH RECURSIVE " + _insert(
    "user", "t_new_user", f"username, email, password_hash, first_name, last_name, phone, 'user' AS role, {NOW} AS created_at", [],
    "request_id, username, email, role, created_at",
    dup="passing AS (SELECT * FROM ruled WHERE first_reasons = '')," + _one_by_one("passing") + """,
judged AS (SELECT r.*, concat_ws(',', NULLIF(r.first_reasons, ''), NULLIF(d.dup, '')) AS reasons FROM ruled r LEFT JOIN duplicates d ON d.request_id = r.request_id)"""))

sql("assign_ids", """
SELECT request_id, CAST((SELECT max(comment_id) FROM t_comment) + row_number() OVER (ORDER BY request_id) AS BIGINT) AS comment_id
FROM t_new_comment
""")

sql("apply_status_changes", f"""
WITH ok AS (
  SELECT c.* FROM t_status_change c JOIN t_issue i ON i.issue_id = c.issue_id
  WHERE c.status IN ('To Do', 'In Progress', 'In Review', 'Done', 'Blocked')),
last AS (SELECT issue_id, status FROM (
  SELECT issue_id, status, row_number() OVER (PARTITION BY issue_id ORDER BY change_id DESC) AS rn FROM ok) WHERE rn = 1)
SELECT i.issue_id, COALESCE(l.status, i.status) AS status,
  CASE WHEN l.issue_id IS NOT NULL THEN {NOW} ELSE i.updated_date END AS updated_date
FROM t_issue i LEFT JOIN last l ON l.issue_id = i.issue_id
""")

sql("apply_assignments", f"""
WITH ok AS (
  SELECT a.change_id, a.issue_id, a.assignee_id, i.assignee_id AS old_assignee
  FROM t_assignment a JOIN t_issue i ON i.issue_id = a.issue_id
  WHERE a.assignee_id IS NULL OR EXISTS (SELECT 1 FROM t_user u WHERE u.user_id = a.assignee_id)),
last AS (SELECT issue_id, assignee_id FROM (
  SELECT issue_id, assignee_id, row_number() OVER (PARTITION BY issue_id ORDER BY change_id DESC) AS rn FROM ok) WHERE rn = 1),
moved AS (SELECT DISTINCT issue_id FROM ok WHERE assignee_id IS DISTINCT FROM old_assignee)
SELECT i.issue_id, CASE WHEN l.issue_id IS NOT NULL THEN l.assignee_id ELSE i.assignee_id END AS assignee_id,
  CASE WHEN m.issue_id IS NOT NULL THEN {NOW} ELSE i.updated_date END AS updated_date
FROM t_issue i LEFT JOIN last l ON l.issue_id = i.issue_id LEFT JOIN moved m ON m.issue_id = i.issue_id
""")

SPRINT_OUTCOMES = """
SELECT r.request_id, r.issue_id, r.sprint_id,
  CASE WHEN i.issue_id IS NULL THEN 'rejected'
       WHEN r.sprint_id IS NULL THEN 'unassigned'
       WHEN s.sprint_id IS NULL OR s.project_id <> i.project_id THEN 'rejected'
       ELSE 'assigned' END AS outcome,
  CASE WHEN i.issue_id IS NULL THEN 'Issue not found'
       WHEN r.sprint_id IS NOT NULL AND (s.sprint_id IS NULL OR s.project_id <> i.project_id)
         THEN 'Target sprint does not exist or belongs to a different project.' END AS reason
FROM t_sprint_request r LEFT JOIN t_issue i ON i.issue_id = r.issue_id LEFT JOIN t_sprint s ON s.sprint_id = r.sprint_id"""
sql("apply_sprint_requests", SPRINT_OUTCOMES)

sql("apply_sprint_requests_issues", f"""
WITH last AS (SELECT issue_id, sprint_id FROM (
  SELECT issue_id, sprint_id, row_number() OVER (PARTITION BY issue_id ORDER BY request_id DESC) AS rn
  FROM ({SPRINT_OUTCOMES}) o WHERE outcome <> 'rejected') WHERE rn = 1)
SELECT i.issue_id, CASE WHEN l.issue_id IS NOT NULL THEN l.sprint_id ELSE i.sprint_id END AS sprint_id,
  CASE WHEN l.issue_id IS NOT NULL THEN {NOW} ELSE i.updated_date END AS updated_date
FROM t_issue i LEFT JOIN last l ON l.issue_id = i.issue_id
""")

_fields = ["description", "issue_type", "priority", "due_date", "story_points", "parent_issue_id"]
_last = ",\n".join(
    f"f_{f} AS (SELECT pk, {f} FROM (SELECT pk, {f}, row_number() OVER (PARTITION BY pk ORDER BY change_id DESC) AS rn "
    f"FROM ok WHERE list_contains(set_fields, '{f}')) WHERE rn = 1)" for f in _fields)
_new = ",\n  ".join(f"CASE WHEN f_{f}.pk IS NOT NULL THEN f_{f}.{f} ELSE i.{f} END AS {f}" for f in _fields)
# Some accepted patch set a value other than the old one: the row changed on the way.
_changed = "EXISTS (SELECT 1 FROM moved m WHERE m.pk = i.issue_id)"
_moved = " OR ".join(f"(list_contains(p.set_fields, '{f}') AND p.{f} IS DISTINCT FROM o.{f})" for f in _fields)
_joins = "\n".join(f"LEFT JOIN f_{f} ON f_{f}.pk = i.issue_id" for f in _fields)
sql("apply_patches", f"""
WITH ok AS (
  SELECT * FROM t_issue_patch p
  WHERE EXISTS (SELECT 1 FROM t_issue i WHERE i.issue_id = p.pk)
    AND NOT (list_contains(set_fields, 'description') AND (description IS NULL OR length(description) < 1))
    AND NOT (list_contains(set_fields, 'issue_type') AND (issue_type IS NULL OR issue_type NOT IN ('Task', 'Bug', 'Story', 'Epic')))
    AND NOT (list_contains(set_fields, 'priority') AND (priority IS NULL OR priority NOT IN ('Highest', 'High', 'Medium', 'Low', 'Lowest')))
    AND NOT (list_contains(set_fields, 'story_points') AND story_points < 0)
    AND NOT (list_contains(set_fields, 'parent_issue_id') AND parent_issue_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t_issue q WHERE q.issue_id = p.parent_issue_id))),
moved AS (SELECT DISTINCT p.pk FROM ok p JOIN t_issue o ON o.issue_id = p.pk WHERE {_moved}),
{_last}
SELECT i.issue_id,
  {_new},
  i.status, i.assignee_id, i.sprint_id,
  CASE WHEN {_changed} THEN {NOW} ELSE i.updated_date END AS updated_date
FROM t_issue i
{_joins}
""")

sql("delete_project_cascade", """
WITH dp AS (SELECT project_id FROM t_project WHERE project_id IN (SELECT pk FROM t_delete_project)),
ds AS (SELECT sprint_id FROM t_sprint WHERE project_id IN (SELECT project_id FROM dp)),
di AS (SELECT issue_id FROM t_issue WHERE project_id IN (SELECT project_id FROM dp)),
rep AS (
  SELECT 'project' AS table_name, 'deleted' AS action, count(*) AS row_count FROM dp
  UNION ALL SELECT 'sprint', 'deleted', count(*) FROM ds
  UNION ALL SELECT 'issue', 'deleted', count(*) FROM di
  UNION ALL SELECT 'comment', 'deleted', count(*) FROM t_comment WHERE issue_id IN (SELECT issue_id FROM di)
  UNION ALL SELECT 'attachment', 'deleted', count(*) FROM t_attachment WHERE issue_id IN (SELECT issue_id FROM di)
  UNION ALL SELECT 'worklog', 'deleted', count(*) FROM t_worklog WHERE issue_id IN (SELECT issue_id FROM di)
  UNION ALL SELECT 'issue', 'set_null:sprint_id', count(*) FROM t_issue
    WHERE issue_id NOT IN (SELECT issue_id FROM di) AND sprint_id IN (SELECT sprint_id FROM ds)
  UNION ALL SELECT 'issue', 'set_null:parent_issue_id', count(*) FROM t_issue
    WHERE issue_id NOT IN (SELECT issue_id FROM di) AND parent_issue_id IN (SELECT issue_id FROM di))
SELECT table_name, action, row_count FROM rep WHERE row_count > 0
""")

sql("delete_user_setnull", """
WITH du AS (SELECT user_id FROM t_user WHERE user_id IN (SELECT pk FROM t_delete_user)),
rep AS (
  SELECT 'user' AS table_name, 'deleted' AS action, count(*) AS row_count FROM du
  UNION ALL SELECT 'project', 'set_null:owner_id', count(*) FROM t_project WHERE owner_id IN (SELECT user_id FROM du)
  UNION ALL SELECT 'issue', 'set_null:reporter_id', count(*) FROM t_issue WHERE reporter_id IN (SELECT user_id FROM du)
  UNION ALL SELECT 'issue', 'set_null:assignee_id', count(*) FROM t_issue WHERE assignee_id IN (SELECT user_id FROM du)
  UNION ALL SELECT 'comment', 'set_null:user_id', count(*) FROM t_comment WHERE user_id IN (SELECT user_id FROM du)
  UNION ALL SELECT 'attachment', 'set_null:user_id', count(*) FROM t_attachment WHERE user_id IN (SELECT user_id FROM du)
  UNION ALL SELECT 'worklog', 'set_null:user_id', count(*) FROM t_worklog WHERE user_id IN (SELECT user_id FROM du))
SELECT table_name, action, row_count FROM rep WHERE row_count > 0
""")

sql("issue_touch", """
SELECT i.issue_id,
  CASE WHEN e.t IS NULL THEN i.updated_date WHEN i.updated_date IS NULL OR e.t > i.updated_date THEN e.t
       ELSE i.updated_date END AS updated_date
FROM t_issue i LEFT JOIN (
  SELECT issue_id, max(ts) AS t FROM t_activity
  WHERE kind IN ('comment_insert', 'comment_update', 'worklog_insert', 'attachment_insert') AND ts IS NOT NULL
  GROUP BY issue_id) e ON e.issue_id = i.issue_id
""")

sql("reject_duplicates", "WITH RECURSIVE " + _one_by_one("t_new_user").lstrip() + """
SELECT request_id, dup = '' AS accepted, dup AS reasons FROM duplicates
""")

sql("apply_patches_rejected", """
WITH judged AS (
  SELECT change_id, pk, concat_ws(',',
    CASE WHEN list_contains(set_fields, 'description') AND description IS NULL THEN 'description:missing' END,
    CASE WHEN list_contains(set_fields, 'issue_type') AND issue_type IS NULL THEN 'issue_type:missing' END,
    CASE WHEN list_contains(set_fields, 'priority') AND priority IS NULL THEN 'priority:missing' END,
    CASE WHEN list_contains(set_fields, 'issue_type') AND issue_type NOT IN ('Task', 'Bug', 'Story', 'Epic') THEN 'issue_type:not_allowed' END,
    CASE WHEN list_contains(set_fields, 'priority') AND priority NOT IN ('Highest', 'High', 'Medium', 'Low', 'Lowest') THEN 'priority:not_allowed' END,
    CASE WHEN list_contains(set_fields, 'description') AND length(description) < 1 THEN 'description:too_short' END,
    CASE WHEN list_contains(set_fields, 'story_points') AND story_points < 0 THEN 'story_points:negative' END,
    CASE WHEN list_contains(set_fields, 'parent_issue_id') AND parent_issue_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t_issue q WHERE q.issue_id = p.parent_issue_id)
      THEN 'parent_issue_id:unknown_parent' END) AS r
  FROM t_issue_patch p)
SELECT change_id, pk, CASE WHEN r <> '' THEN r ELSE 'issue_id:not_found' END AS reasons FROM judged j
WHERE r <> '' OR NOT EXISTS (SELECT 1 FROM t_issue i WHERE i.issue_id = j.pk)
""")

sql("apply_status_changes_rejected", """
SELECT change_id, issue_id, status,
  CASE WHEN status IS NULL OR status NOT IN ('To Do', 'In Progress', 'In Review', 'Done', 'Blocked') THEN 'status:not_allowed' ELSE 'Issue not found' END AS reason
FROM t_status_change c
WHERE status IS NULL OR status NOT IN ('To Do', 'In Progress', 'In Review', 'Done', 'Blocked')
  OR NOT EXISTS (SELECT 1 FROM t_issue i WHERE i.issue_id = c.issue_id)
""")

sql("apply_assignments_rejected", """
SELECT change_id, issue_id, assignee_id,
  CASE WHEN assignee_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t_user u WHERE u.user_id = a.assignee_id) THEN 'assignee_id:unknown_parent' ELSE 'Issue not found' END AS reason
FROM t_assignment a
WHERE (assignee_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t_user u WHERE u.user_id = a.assignee_id))
  OR NOT EXISTS (SELECT 1 FROM t_issue i WHERE i.issue_id = a.issue_id)
""")

sql("delete_project_cascade_issues", """
WITH dp AS (SELECT project_id FROM t_project WHERE project_id IN (SELECT pk FROM t_delete_project))
SELECT i.issue_id, i.project_id,
  CASE WHEN EXISTS (SELECT 1 FROM t_sprint s WHERE s.sprint_id = i.sprint_id AND s.project_id IN (SELECT project_id FROM dp)) THEN NULL ELSE i.sprint_id END AS sprint_id,
  CASE WHEN EXISTS (SELECT 1 FROM t_issue p WHERE p.issue_id = i.parent_issue_id AND p.project_id IN (SELECT project_id FROM dp)) THEN NULL ELSE i.parent_issue_id END AS parent_issue_id
FROM t_issue i WHERE i.project_id NOT IN (SELECT project_id FROM dp)
""")

sql("delete_user_setnull_issues", """
SELECT issue_id,
  CASE WHEN reporter_id IN (SELECT pk FROM t_delete_user) THEN NULL ELSE reporter_id END AS reporter_id,
  CASE WHEN assignee_id IN (SELECT pk FROM t_delete_user) THEN NULL ELSE assignee_id END AS assignee_id, parent_issue_id
FROM t_issue
""")

# Deletes rooted at the other tables: (child, column) pairs that go with the root, and that lose the reference.
for _root, _go, _clear in [("sprint", [], [("issue", "sprint_id")]),
                           ("issue", [("comment", "issue_id"), ("attachment", "issue_id"), ("worklog", "issue_id")], [("issue", "parent_issue_id")]),
                           ("comment", [], []), ("attachment", [], []), ("worklog", [], [])]:
    _rows = [f"SELECT '{_root}' AS table_name, 'deleted' AS action, count(*) AS row_count FROM gone"]
    _rows += [f"SELECT '{c}', 'deleted', count(*) FROM t_{c} WHERE {col} IN (SELECT k FROM gone)" for c, col in _go]
    _rows += [f"SELECT '{c}', 'set_null:{col}', count(*) FROM t_{c} WHERE {col} IN (SELECT k FROM gone)"
              + (f" AND {PK[c]} NOT IN (SELECT k FROM gone)" if c == _root else "") for c, col in _clear]
    sql(f"delete_{_root}", f"""
WITH gone AS (SELECT {PK[_root]} AS k FROM t_{_root} WHERE {PK[_root]} IN (SELECT pk FROM t_some_key))
SELECT * FROM ({' UNION ALL '.join(_rows)}) r WHERE row_count > 0
""")

sql("comment_edit_touch", f"""
SELECT issue_id, CASE WHEN issue_id IN (SELECT issue_id FROM t_comment WHERE comment_id % 5 = 0 OR comment_id % 3 = 0)
    AND (updated_date IS NULL OR updated_date < {NOW}) THEN {NOW} ELSE updated_date END AS updated_date
FROM t_issue
""")


def _patch_texts(table, fields, refs, moved, unique="", before=""):
    """(new rows, refused patches) of a table's patch view. The row rules are those of the
    validity checks, for the fields a patch sets; ``refs``: (column, parent)."""
    pk, tests = PK[table], []
    for cond, col, code in re.findall(r"CASE WHEN (.*) THEN '(\w+):(\w+)' END", REASONS[table]):
        if col in fields:
            tests.append(f"CASE WHEN list_contains(set_fields, '{col}') AND ({cond}) THEN '{col}:{code}' END")
    for col, parent in refs:
        tests.append(f"CASE WHEN list_contains(set_fields, '{col}') AND {col} IS NOT NULL AND NOT EXISTS "
                     f"(SELECT 1 FROM t_{parent} q WHERE q.{PK[parent]} = p.{col}) THEN '{col}:unknown_parent' END")
    value = lambda f: "TRY_CAST(round_even(hours_logged, 2) AS DECIMAL(5,2))" if f == "hours_logged" else f
    ctes = f"""
ruled AS (SELECT *, concat_ws(',', {', '.join(tests)}) AS r0 FROM t_{table}_patch p),{before}
judged AS (SELECT *, concat_ws(',', NULLIF(r0, ''){unique}) AS r FROM ruled p),
ok AS (SELECT change_id, pk, set_fields, {', '.join(f'{value(f)} AS {f}' if f == 'hours_logged' else f for f in fields)} FROM judged j
  WHERE r = '' AND EXISTS (SELECT 1 FROM t_{table} x WHERE x.{pk} = j.pk)),
""" + ",\n".join(
        f"f_{f} AS (SELECT pk, {f} FROM (SELECT pk, {f}, row_number() OVER (PARTITION BY pk ORDER BY change_id DESC) AS rn "
        f"FROM ok WHERE list_contains(set_fields, '{f}')) WHERE rn = 1)" for f in fields)
    changed = " OR ".join(f"(list_contains(o.set_fields, '{f}') AND o.{f} IS DISTINCT FROM x.{f})" for f in fields)
    instant = "".join(f", CASE WHEN EXISTS (SELECT 1 FROM ok o WHERE o.pk = x.{pk} AND ({changed})) THEN {NOW} ELSE x.{m} END AS {m}" for m in moved)
    rows = ", ".join(f"CASE WHEN f_{f}.pk IS NOT NULL THEN f_{f}.{f} ELSE x.{f} END AS {f}" for f in fields)
    joins = " ".join(f"LEFT JOIN f_{f} ON f_{f}.pk = x.{pk}" for f in fields)
    refused = f"""SELECT change_id, pk, CASE WHEN r <> '' THEN r ELSE '{pk}:not_found' END AS reasons FROM judged j
WHERE r <> '' OR NOT EXISTS (SELECT 1 FROM t_{table} x WHERE x.{pk} = j.pk)"""
    head = "WITH RECURSIVE" if before else "WITH"
    return f"{head} {ctes}\nSELECT x.{pk}, {rows}{instant} FROM t_{table} x {joins}", f"{head} {ctes}\n{refused}"


# Email patches one by one: a list holds every user's address; a patch that keeps the rules
# is refused when the address stands at another user's place, else it replaces its own.
_EMAIL = ", CASE WHEN p.change_id IN (SELECT change_id FROM step WHERE NOT ok) THEN 'email:duplicate' END"
_EMAIL_TURNS = """
places AS (SELECT user_id, lower(email) AS e, row_number() OVER (ORDER BY user_id) AS place FROM t_user),
turns AS (
  SELECT m.change_id, lower(m.email) AS e, x.place, row_number() OVER (ORDER BY m.change_id) AS k
  FROM ruled m JOIN places x ON x.user_id = m.pk WHERE m.r0 = '' AND list_contains(m.set_fields, 'email') AND m.email IS NOT NULL),
step AS (
  SELECT CAST(0 AS BIGINT) AS k, (SELECT list(e ORDER BY place) FROM places) AS held, CAST(NULL AS BIGINT) AS change_id, true AS ok
  UNION ALL
  SELECT t.k, CASE WHEN coalesce(list_position(s.held, t.e), 0) IN (0, t.place)
      THEN list_concat(list_concat(s.held[1:t.place - 1], [t.e]), s.held[t.place + 1:]) ELSE s.held END,
    t.change_id, coalesce(list_position(s.held, t.e), 0) IN (0, t.place)
  FROM step s JOIN turns t ON t.k = s.k + 1),"""
for _table, _args in {"user": (["email", "first_name", "last_name", "phone"], [], [], _EMAIL, _EMAIL_TURNS),
                      "project": (["project_name", "description", "end_date", "status", "owner_id"], [("owner_id", "user")], ["updated_at"]),
                      "sprint": (["sprint_name", "goal", "status"], [], ["updated_at"]),
                      "worklog": (["hours_logged", "work_date", "description"], [], []),
                      "comment": (["comment_text"], [], ["updated_at"])}.items():
    _rows, _refused = _patch_texts(_table, *_args)
    sql(f"patch_{_table}s", _rows)
    sql(f"patch_{_table}s_rejected", _refused)


# A mixed change log. Every row has a life (k, born, died] in change ids; parents before children.
def _there(life, ref, at="c.change_id", extra=""):
    return f"EXISTS (SELECT 1 FROM life_{life} x WHERE x.k = {ref} AND x.born < {at} AND (x.died IS NULL OR x.died > {at}){extra})"


def _reference(col, parent, same=False):
    out = f", CASE WHEN c.{col} IS NOT NULL AND NOT {_there(parent, 'c.' + col)} THEN '{col}:unknown_parent' END"
    if same:
        out += f", CASE WHEN c.{col} IS NOT NULL AND {_there(parent, 'c.' + col, extra=' AND x.project_id <> c.project_id')} THEN '{col}:other_project' END"
    return out


def _life(table, rows, cascade=None):
    """Life of ``rows (k, born, project_id, up)``: until its first delete, or the death of its parent ``up``."""
    parent = f", (SELECT min(p.died) FROM life_{cascade} p WHERE p.k = r.up)" if cascade else ""
    return f"""SELECT k, born, project_id, least((SELECT min(d.change_id) FROM log d WHERE d.table_name = '{table}' AND d.action = 'delete' AND d.pk = r.k AND d.change_id > r.born)
    {parent or ', NULL'}) AS died FROM ({rows}) r"""


def _made(table, cols):
    rules = "\n".join(x for x in REASONS[table].split("\n") if f"WHEN {PK[table]} IS NULL" not in x)
    return f"""SELECT *, NULLIF({rules}, '') AS ruled,
    CASE WHEN EXISTS (SELECT 1 FROM t_{table} x WHERE x.{PK[table]} = m.pk) OR EXISTS (SELECT 1 FROM log e WHERE e.table_name = '{table}' AND e.action = 'insert' AND e.pk = m.pk AND e.change_id < m.change_id)
      THEN '{PK[table]}:taken' END AS taken
  FROM (SELECT change_id, ts, pk, {cols} FROM log WHERE table_name = '{table}' AND action = 'insert') m"""


_SETTERS = {"issue": ["description", "story_points", "parent_issue_id", "status", "assignee_id", "sprint_id"], "comment": ["comment_text"], "worklog": ["hours_logged"]}
_REF = {"parent_issue_id": "issue", "assignee_id": "user", "sprint_id": "sprint"}


def _updates(table, refs):
    """Updates of a table with their reasons, their accepted setters, and what these really changed."""
    fields, tests = _SETTERS[table], []
    for cond, col, code in re.findall(r"CASE WHEN (.*) THEN '(\w+):(\w+)' END", REASONS[table]):
        if col in fields:
            tests.append(f"CASE WHEN list_contains(fields, '{col}') AND ({cond}) THEN '{col}:{code}' END")
    for col, same in refs:
        tests.append(_reference(col, _REF[col], same)[2:].replace(f"c.{col} IS NOT NULL", f"list_contains(fields, '{col}') AND c.{col} IS NOT NULL"))
    value = lambda f: f"CAST(round_even({f}, 2) AS DECIMAL(5,2))" if f == "hours_logged" else f
    return f"""
{table}_asked AS (
  SELECT l.* EXCLUDE (project_id), x.project_id, CASE action WHEN 'status' THEN ['status'] WHEN 'assign' THEN ['assignee_id'] WHEN 'sprint' THEN ['sprint_id']
    ELSE list_filter(set_fields, lambda f: list_contains({[f for f in fields if f not in ('status', 'assignee_id', 'sprint_id')]}, f)) END AS fields,
    x.k IS NOT NULL AND x.born < l.change_id AND (x.died IS NULL OR x.died > l.change_id) AS there
  FROM log l LEFT JOIN life_{table} x ON x.k = l.pk WHERE table_name = '{table}' AND action IN ('patch', 'status', 'assign', 'sprint')),
{table}_updates AS (SELECT c.*, CASE WHEN there THEN NULLIF(concat_ws(',', {', '.join(tests)}), '') ELSE '{PK[table]}:not_found' END AS reasons FROM {table}_asked c),
{table}_base AS (
  SELECT {PK[table]} AS pk, CAST(-1 AS BIGINT) AS born, {', '.join(fields)} FROM t_{table}
  UNION ALL SELECT pk, change_id, {', '.join(value(f) for f in fields)} FROM {table}_in WHERE ok),
{table}_setters AS ({' UNION ALL '.join(f"SELECT pk, '{f}' AS field, change_id, ts, action, CAST({value(f)} AS VARCHAR) AS v FROM {table}_updates WHERE reasons IS NULL AND list_contains(fields, '{f}') UNION ALL SELECT pk, '{f}', born, NULL, 'base', CAST({f} AS VARCHAR) FROM {table}_base" for f in fields)}),
{table}_ordered AS (SELECT *, lag(v) OVER (PARTITION BY pk, field ORDER BY change_id) AS old FROM {table}_setters),
{table}_real AS (
  SELECT * FROM (SELECT *, CASE {' '.join(f"WHEN field = '{f}' AND EXISTS (SELECT 1 FROM life_{_REF[f]} x WHERE CAST(x.k AS VARCHAR) = old AND x.died < change_id) THEN NULL" for f in fields if f in _REF)}
    {"WHEN false THEN NULL" if not any(f in _REF for f in fields) else ""} ELSE old END AS before FROM {table}_ordered WHERE action <> 'base') o WHERE before IS DISTINCT FROM v),
{table}_last AS (SELECT pk, {', '.join(f"max(struct_pack(k := change_id, v := v)) FILTER (field = '{f}') AS {f}" for f in fields)} FROM {table}_setters GROUP BY pk)"""


CHANGE_LOG = f"""
WITH RECURSIVE log AS (SELECT * REPLACE (CASE WHEN table_name = 'issue' THEN status END AS status) FROM t_change_log),
life_user AS ({_life('user', 'SELECT user_id AS k, CAST(-1 AS BIGINT) AS born, NULL AS project_id FROM t_user')}),
life_project AS ({_life('project', 'SELECT project_id AS k, CAST(-1 AS BIGINT) AS born, NULL AS project_id FROM t_project')}),
sprint_in AS (SELECT *, reasons = '' AS ok FROM (SELECT *, concat_ws(',', ruled, taken{_reference('project_id', 'project')}) AS reasons
  FROM ({_made('sprint', "pk AS sprint_id, project_id, sprint_name, goal, COALESCE(status, 'future') AS status")}) c) j),
life_sprint AS ({_life('sprint', 'SELECT sprint_id AS k, CAST(-1 AS BIGINT) AS born, project_id, project_id AS up FROM t_sprint UNION ALL SELECT pk, change_id, project_id, project_id FROM sprint_in WHERE ok', 'project')}),
issue_own AS (SELECT *, concat_ws(',', ruled, taken{_reference('project_id', 'project')}{_reference('sprint_id', 'sprint', True)}{_reference('reporter_id', 'user')}{_reference('assignee_id', 'user')}) AS own
  FROM ({_made('issue', "pk AS issue_id, project_id, sprint_id, parent_issue_id, description, 'Task' AS issue_type, 'Medium' AS priority, 'To Do' AS status, reporter_id, assignee_id, story_points")}) c),
life_candidate AS ({_life('issue', "SELECT issue_id AS k, CAST(-1 AS BIGINT) AS born, project_id, project_id AS up FROM t_issue UNION ALL SELECT pk, change_id, project_id, project_id FROM issue_own WHERE own = ''", 'project')}),
stands AS (
  SELECT c.pk FROM issue_own c WHERE own = '' AND (c.parent_issue_id IS NULL OR {_there('candidate', 'c.parent_issue_id', extra=' AND x.born = -1 AND x.project_id = c.project_id')})
  UNION SELECT c.pk FROM issue_own c JOIN stands s ON s.pk = c.parent_issue_id WHERE own = '' AND {_there('candidate', 'c.parent_issue_id', extra=' AND x.project_id = c.project_id')}),
life_issue AS (SELECT * FROM life_candidate WHERE born = -1 OR k IN (SELECT pk FROM stands)),
issue_in AS (SELECT *, reasons = '' AS ok FROM (SELECT *, concat_ws(',', NULLIF(own, ''){_reference('parent_issue_id', 'issue', True)}) AS reasons FROM issue_own c) j),
comment_in AS (SELECT *, reasons = '' AS ok FROM (SELECT *, concat_ws(',', ruled, taken{_reference('issue_id', 'issue')}{_reference('user_id', 'user')}) AS reasons
  FROM ({_made('comment', 'pk AS comment_id, issue_id, user_id, comment_text')}) c) j),
life_comment AS ({_life('comment', 'SELECT comment_id AS k, CAST(-1 AS BIGINT) AS born, NULL AS project_id, issue_id AS up FROM t_comment UNION ALL SELECT pk, change_id, NULL, issue_id FROM comment_in WHERE ok', 'issue')}),
worklog_in AS (SELECT *, reasons = '' AS ok FROM (SELECT *, concat_ws(',', ruled, taken{_reference('issue_id', 'issue')}{_reference('user_id', 'user')}) AS reasons
  FROM ({_made('worklog', 'pk AS worklog_id, issue_id, user_id, hours_logged, work_date')}) c) j),
life_worklog AS ({_life('worklog', 'SELECT worklog_id AS k, CAST(-1 AS BIGINT) AS born, NULL AS project_id, issue_id AS up FROM t_worklog UNION ALL SELECT pk, change_id, NULL, issue_id FROM worklog_in WHERE ok', 'issue')}),
{_updates('issue', [('sprint_id', True), ('assignee_id', False), ('parent_issue_id', False)])},
{_updates('comment', [])},
{_updates('worklog', [])},
sprint_updates AS (SELECT c.*, CASE WHEN {_there('sprint', 'c.pk')} THEN NULL ELSE 'sprint_id:not_found' END AS reasons FROM log c WHERE table_name = 'sprint' AND action = 'patch'),
touched AS (
  SELECT pk, max(struct_pack(k := change_id, ts := ts)) AS t FROM (
    SELECT pk, change_id, ts FROM issue_real UNION ALL SELECT pk, change_id, ts FROM issue_updates WHERE reasons IS NULL AND action IN ('status', 'sprint')
    UNION ALL SELECT issue_id, change_id, ts FROM comment_in WHERE ok UNION ALL SELECT issue_id, change_id, ts FROM worklog_in WHERE ok
    UNION ALL SELECT b.issue_id, r.change_id, r.ts FROM comment_real r JOIN (SELECT comment_id AS pk, issue_id FROM t_comment UNION ALL SELECT pk, issue_id FROM comment_in WHERE ok) b ON b.pk = r.pk
      WHERE lower(r.before) <> lower(r.v)) e GROUP BY pk)"""


def _kept(ref, life):
    """A reference, or null if its row has died."""
    return f"CASE WHEN EXISTS (SELECT 1 FROM life_{life} x WHERE x.k = {ref} AND x.died IS NOT NULL) THEN NULL ELSE {ref} END"


sql("change_log_issues", CHANGE_LOG + f"""
SELECT issue_id, project_id, {_kept('sprint_id', 'sprint')} AS sprint_id, {_kept('parent_issue_id', 'issue')} AS parent_issue_id, description, status,
  {_kept('reporter_id', 'user')} AS reporter_id, {_kept('assignee_id', 'user')} AS assignee_id, story_points, coalesce(t.ts, updated_date) AS updated_date
FROM (
  SELECT CAST(b.issue_id AS INT) AS issue_id, b.project_id, CAST(l.sprint_id.v AS INT) AS sprint_id, CAST(l.parent_issue_id.v AS INT) AS parent_issue_id, l.description.v AS description, l.status.v AS status,
    b.reporter_id, CAST(l.assignee_id.v AS INT) AS assignee_id, CAST(l.story_points.v AS INT) AS story_points, b.updated_date, t.t AS t
  FROM (SELECT issue_id, project_id, reporter_id, updated_date FROM t_issue UNION ALL SELECT pk, project_id, reporter_id, NULL FROM issue_in WHERE ok) b
  JOIN issue_last l ON l.pk = b.issue_id JOIN life_issue f ON f.k = b.issue_id AND f.died IS NULL LEFT JOIN touched t ON t.pk = b.issue_id) r
""")
sql("change_log_comments", CHANGE_LOG + f"""
SELECT comment_id, issue_id, {_kept('user_id', 'user')} AS user_id, comment_text, coalesce(t.ts, updated_at) AS updated_at
FROM (
  SELECT b.comment_id, b.issue_id, b.user_id, l.comment_text.v AS comment_text, b.updated_at, r.t AS t
  FROM (SELECT comment_id, issue_id, user_id, updated_at FROM t_comment UNION ALL SELECT pk, issue_id, user_id, NULL FROM comment_in WHERE ok) b
  JOIN comment_last l ON l.pk = b.comment_id JOIN life_comment f ON f.k = b.comment_id AND f.died IS NULL
  LEFT JOIN (SELECT pk, max(struct_pack(k := change_id, ts := ts)) AS t FROM comment_real GROUP BY pk) r ON r.pk = b.comment_id) r
""")
sql("change_log_worklogs", CHANGE_LOG + f"""
SELECT b.worklog_id, b.issue_id, {_kept('b.user_id', 'user')} AS user_id, CAST(l.hours_logged.v AS DECIMAL(5,2)) AS hours_logged, b.work_date
FROM (SELECT worklog_id, issue_id, user_id, work_date FROM t_worklog UNION ALL SELECT pk, issue_id, user_id, work_date FROM worklog_in WHERE ok) b
JOIN worklog_last l ON l.pk = b.worklog_id JOIN life_worklog f ON f.k = b.worklog_id AND f.died IS NULL
""")
_deleted = " UNION ALL ".join(
    f"SELECT change_id, '{PK[t]}:not_found' AS reasons FROM log d WHERE table_name = '{t}' AND action = 'delete' AND NOT EXISTS (SELECT 1 FROM life_{t} x WHERE x.k = d.pk AND x.died = d.change_id)"
    for t in ("user", "project", "sprint", "issue", "comment", "worklog"))
sql("change_log_refused", CHANGE_LOG + f""",
every AS ({_deleted}
  {' '.join(f"UNION ALL SELECT change_id, reasons FROM {t}_in WHERE NOT ok" for t in ('sprint', 'issue', 'comment', 'worklog'))}
  {' '.join(f"UNION ALL SELECT change_id, reasons FROM {t}_updates WHERE reasons IS NOT NULL" for t in ('sprint', 'issue', 'comment', 'worklog'))}
  UNION ALL SELECT change_id, 'action:not_supported' FROM log WHERE action = 'merge')
SELECT e.change_id, l.table_name, l.action, l.pk, array_to_string(list_sort(string_split(e.reasons, ',')), ',') AS reasons FROM every e JOIN log l ON l.change_id = e.change_id
""")
