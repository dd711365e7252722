"""Oracle bodies for sources, lookups, joins and reports."""

from .oracle import sql

sql("hours_by_user", """
SELECT i.project_id, w.user_id, u.username, CAST(SUM(w.hours_logged) AS DECIMAL(18,2)) AS total_user_hours
FROM t_worklog w JOIN t_user u ON w.user_id = u.user_id JOIN t_issue i ON w.issue_id = i.issue_id
GROUP BY i.project_id, w.user_id, u.username
ORDER BY i.project_id, total_user_hours DESC, w.user_id
""")

sql("issue_hours", """
SELECT i.issue_id, CAST(COALESCE(SUM(w.hours_logged), 0) AS DECIMAL(18,2)) AS total_hours
FROM t_issue i LEFT JOIN t_worklog w ON w.issue_id = i.issue_id
GROUP BY i.issue_id
""")

sql("project_hours", """
SELECT p.project_id, CAST(COALESCE(SUM(w.hours_logged), 0) AS DECIMAL(18,2)) AS total_hours
FROM t_project p LEFT JOIN t_issue i ON i.project_id = p.project_id LEFT JOIN t_worklog w ON w.issue_id = i.issue_id
GROUP BY p.project_id
""")

ISSUE_ENRICHED = """
SELECT i.issue_id, i.project_id, i.sprint_id, i.description, i.issue_type, i.priority, i.status,
  i.reporter_id, i.assignee_id, i.created_date, i.due_date, i.updated_date, i.story_points,
  i.parent_issue_id, p.project_key, s.sprint_name, r.username AS reporter_username,
  a.username AS assignee_username
FROM t_issue i JOIN t_project p ON i.project_id = p.project_id
LEFT JOIN t_sprint s ON i.sprint_id = s.sprint_id
LEFT JOIN t_user r ON i.reporter_id = r.user_id
LEFT JOIN t_user a ON i.assignee_id = a.user_id"""

ISSUE_HOURS = """
SELECT i.issue_id, CAST(COALESCE(SUM(w.hours_logged), 0) AS DECIMAL(18,2)) AS total_hours
FROM t_issue i LEFT JOIN t_worklog w ON w.issue_id = i.issue_id GROUP BY i.issue_id"""

HOURS_BY_USER = """
SELECT i.project_id, w.user_id, u.username, CAST(SUM(w.hours_logged) AS DECIMAL(18,2)) AS total_user_hours
FROM t_worklog w JOIN t_user u ON w.user_id = u.user_id JOIN t_issue i ON w.issue_id = i.issue_id
GROUP BY i.project_id, w.user_id, u.username"""

sql("user_issue_counts", """
SELECT u.user_id, r.role, CAST(COALESCE(c.n, 0) AS BIGINT) AS issue_count
FROM t_user u CROSS JOIN (VALUES ('reporter'), ('assignee')) r(role)
LEFT JOIN (
  SELECT reporter_id AS user_id, 'reporter' AS role, count(*) AS n FROM t_issue WHERE reporter_id IS NOT NULL GROUP BY reporter_id
  UNION ALL
  SELECT assignee_id, 'assignee', count(*) FROM t_issue WHERE assignee_id IS NOT NULL GROUP BY assignee_id
) c ON c.user_id = u.user_id AND c.role = r.role
""")

sql("project_issue_counts", """
SELECT p.project_id, CAST(count(i.issue_id) AS BIGINT) AS issue_count
FROM t_project p LEFT JOIN t_issue i ON i.project_id = p.project_id GROUP BY p.project_id
""")

sql("issue_child_counts", """
SELECT i.issue_id,
  CAST(COALESCE((SELECT count(*) FROM t_comment c WHERE c.issue_id = i.issue_id), 0) AS BIGINT) AS comment_count,
  CAST(COALESCE((SELECT count(*) FROM t_worklog w WHERE w.issue_id = i.issue_id), 0) AS BIGINT) AS worklog_count,
  CAST(COALESCE((SELECT count(*) FROM t_attachment a WHERE a.issue_id = i.issue_id), 0) AS BIGINT) AS attachment_count
FROM t_issue i
""")

sql("issue_last_activity", """
SELECT i.issue_id,
  CASE WHEN e.last_touch IS NULL THEN i.updated_date WHEN i.updated_date IS NULL THEN e.last_touch
       WHEN e.last_touch > i.updated_date THEN e.last_touch ELSE i.updated_date END AS last_activity
FROM t_issue i LEFT JOIN (
  SELECT issue_id, max(ts) AS last_touch FROM (
    SELECT issue_id, created_at AS ts FROM t_comment
    UNION ALL SELECT issue_id, updated_at FROM t_comment WHERE updated_at IS NOT NULL
    UNION ALL SELECT issue_id, created_at FROM t_worklog
    UNION ALL SELECT issue_id, uploaded_at FROM t_attachment) x
  WHERE ts IS NOT NULL GROUP BY issue_id) e ON e.issue_id = i.issue_id
""")

sql("hours_delta", f"""
SELECT COALESCE(t.issue_id, d.issue_id) AS issue_id,
  CAST(COALESCE(t.total_hours, 0) + COALESCE(d.delta, 0) AS DECIMAL(18,2)) AS total_hours
FROM ({ISSUE_HOURS}) t
FULL JOIN (
  SELECT issue_id, SUM(CASE kind WHEN 'worklog_insert' THEN hours ELSE -hours END) AS delta
  FROM t_activity WHERE kind IN ('worklog_insert', 'worklog_delete') GROUP BY issue_id
) d ON t.issue_id = d.issue_id
""")

sql("project_report", f"""
SELECT p.project_id, p.project_key, p.project_name, p.status, ph.total_hours,
  CAST(ic.issue_count AS BIGINT) AS issue_count, CAST(COALESCE(sc.sprint_count, 0) AS BIGINT) AS sprint_count,
  hu.user_id, hu.username, hu.total_user_hours
FROM t_project p
JOIN (SELECT p.project_id, CAST(COALESCE(SUM(w.hours_logged), 0) AS DECIMAL(18,2)) AS total_hours
      FROM t_project p LEFT JOIN t_issue i ON i.project_id = p.project_id LEFT JOIN t_worklog w ON w.issue_id = i.issue_id
      GROUP BY p.project_id) ph ON ph.project_id = p.project_id
JOIN (SELECT p.project_id, count(i.issue_id) AS issue_count FROM t_project p LEFT JOIN t_issue i ON i.project_id = p.project_id
      GROUP BY p.project_id) ic ON ic.project_id = p.project_id
LEFT JOIN (SELECT project_id, count(*) AS sprint_count FROM t_sprint GROUP BY project_id) sc ON sc.project_id = p.project_id
LEFT JOIN ({HOURS_BY_USER}) hu ON hu.project_id = p.project_id
""")

sql("project_enriched", """
SELECT p.*, u.username AS owner_username FROM t_project p LEFT JOIN t_user u ON p.owner_id = u.user_id
""")

sql("issue_enriched", ISSUE_ENRICHED)

sql("worklog_enriched", """
SELECT w.*, u.username AS logger_username FROM t_worklog w LEFT JOIN t_user u ON w.user_id = u.user_id
""")

sql("comment_enriched", """
SELECT c.*, u.username AS author_username FROM t_comment c LEFT JOIN t_user u ON c.user_id = u.user_id
""")

sql("attachment_enriched", """
SELECT a.*, u.username AS uploader_username FROM t_attachment a LEFT JOIN t_user u ON a.user_id = u.user_id
""")

sql("issue_with_parent", """
SELECT i.*, p.description AS parent_description FROM t_issue i LEFT JOIN t_issue p ON i.parent_issue_id = p.issue_id
""")

sql("exists_checks", """
SELECT i.issue_id,
  EXISTS (SELECT 1 FROM t_project p WHERE p.project_id = i.project_id) AS project_exists,
  (i.sprint_id IS NULL OR EXISTS (SELECT 1 FROM t_sprint s WHERE s.sprint_id = i.sprint_id AND s.project_id = i.project_id)) AS sprint_in_project,
  (i.parent_issue_id IS NULL OR EXISTS (SELECT 1 FROM t_issue q WHERE q.issue_id = i.parent_issue_id AND q.project_id = i.project_id)) AS parent_in_project
FROM t_issue i
""")

sql("lookup_by_keys", f"""
SELECT * FROM ({ISSUE_ENRICHED}) e WHERE e.issue_id IN (SELECT issue_id FROM t_sprint_request)
""")

sql("lookup_by_natural_key", """
SELECT u.user_id, u.username, u.email, u.role, k.key
FROM t_user u JOIN (SELECT lower(key) AS ck, min(key) AS key FROM (SELECT upper(username) AS key FROM t_new_user) GROUP BY lower(key)) k
  ON lower(u.username) = k.ck
""")

sql("children_of_parent", """
SELECT worklog_id, issue_id, user_id, hours_logged, work_date FROM t_worklog
WHERE issue_id IN (SELECT issue_id FROM t_issue WHERE status = 'Blocked')
""")

sql("issue_filter", f"""
SELECT * FROM ({ISSUE_ENRICHED}) e
WHERE e.project_id = (SELECT project_id FROM t_issue GROUP BY project_id ORDER BY count(*) DESC, project_id LIMIT 1)
""")

sql("backlog", f"""
SELECT * FROM ({ISSUE_ENRICHED}) e WHERE e.sprint_id IS NULL
""")

for _table, _cols in {"user": ["user_id", "username", "role"], "project": ["project_id", "project_key", "status"],
                      "sprint": ["sprint_id", "project_id", "sprint_name"], "comment": ["comment_id", "issue_id", "comment_text"],
                      "attachment": ["attachment_id", "issue_id", "file_name"], "worklog": ["worklog_id", "issue_id", "hours_logged"]}.items():
    sql(f"lookup_{_table}_by_keys", f"SELECT {', '.join(_cols)} FROM t_{_table} WHERE {_cols[0]} IN (SELECT pk FROM t_some_key)")

for _table, _parent in {"comment": "issue_id", "attachment": "issue_id", "sprint": "project_id", "issue": "project_id"}.items():
    sql(f"{_table}s_of_parents", f"SELECT {_table}_id, {_parent} FROM t_{_table} WHERE {_parent} IN (SELECT pk FROM t_some_key)")

sql("worklog_with_user_and_project", """
SELECT w.worklog_id, w.user_id, u.username, i.project_id, w.hours_logged
FROM t_worklog w JOIN t_user u ON u.user_id = w.user_id JOIN t_issue i ON i.issue_id = w.issue_id
""")
