"""Oracle bodies for paging and the issue document."""

from .o_core import ISSUE_ENRICHED, ISSUE_HOURS
from .oracle import sql

sql("page_users", """
SELECT user_id, username, email, first_name, last_name, phone, role, created_at FROM t_user
ORDER BY user_id LIMIT 100 OFFSET 100
""")

sql("page_projects", """
SELECT * FROM (SELECT p.*, u.username AS owner_username FROM t_project p LEFT JOIN t_user u ON p.owner_id = u.user_id)
ORDER BY created_at DESC NULLS LAST, project_id LIMIT 100
""")

sql("page_project_sprints", """
SELECT * FROM t_sprint WHERE project_id = (SELECT project_id FROM t_sprint GROUP BY project_id ORDER BY count(*) DESC, project_id LIMIT 1)
ORDER BY start_date DESC NULLS LAST, created_at DESC NULLS LAST, sprint_id LIMIT 100
""")

sql("page_project_issues", f"""
SELECT * FROM ({ISSUE_ENRICHED}) e WHERE e.project_id = (SELECT project_id FROM t_issue GROUP BY project_id ORDER BY count(*) DESC, project_id LIMIT 1)
ORDER BY created_date DESC NULLS LAST, issue_id LIMIT 100 OFFSET 100
""")

sql("page_sprint_issues", f"""
SELECT * FROM ({ISSUE_ENRICHED}) e WHERE e.sprint_id = (SELECT sprint_id FROM t_issue WHERE sprint_id IS NOT NULL GROUP BY sprint_id ORDER BY count(*) DESC, sprint_id LIMIT 1)
ORDER BY priority ASC NULLS FIRST, created_date DESC NULLS LAST, issue_id LIMIT 100
""")

sql("page_issue_comments", """
SELECT c.*, u.username AS author_username FROM t_comment c LEFT JOIN t_user u ON c.user_id = u.user_id
WHERE c.issue_id = (SELECT issue_id FROM t_comment GROUP BY issue_id ORDER BY count(*) DESC, issue_id LIMIT 1) ORDER BY c.created_at ASC NULLS FIRST, c.comment_id LIMIT 100
""")

sql("page_issue_worklogs", """
SELECT w.*, u.username AS logger_username FROM t_worklog w LEFT JOIN t_user u ON w.user_id = u.user_id
WHERE w.issue_id = (SELECT issue_id FROM t_worklog GROUP BY issue_id ORDER BY count(*) DESC, issue_id LIMIT 1) ORDER BY w.work_date DESC NULLS LAST, w.created_at DESC NULLS LAST, w.worklog_id LIMIT 100
""")

sql("page_issue_attachments", """
SELECT a.*, u.username AS uploader_username FROM t_attachment a LEFT JOIN t_user u ON a.user_id = u.user_id
WHERE a.issue_id = (SELECT issue_id FROM t_attachment GROUP BY issue_id ORDER BY count(*) DESC, issue_id LIMIT 1) ORDER BY a.uploaded_at DESC NULLS LAST, a.attachment_id LIMIT 100
""")

sql("top_k_per_parent", """
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_date DESC NULLS LAST, issue_id) AS INT) AS rn
  FROM t_issue) WHERE rn <= 100
""")

sql("issue_details", f"""
SELECT e.issue_id, e.project_key, e.status, h.total_hours, k.kind, x.pos, x.child_id, x.child_user
FROM ({ISSUE_ENRICHED}) e
JOIN ({ISSUE_HOURS}) h ON h.issue_id = e.issue_id
CROSS JOIN (VALUES ('comments'), ('worklogs'), ('attachments')) k(kind)
LEFT JOIN (
  SELECT * FROM (
    SELECT 'comments' AS kind, c.issue_id, c.comment_id AS child_id, u.username AS child_user,
      CAST(row_number() OVER (PARTITION BY c.issue_id ORDER BY c.created_at ASC NULLS FIRST, c.comment_id) - 1 AS INT) AS pos
    FROM t_comment c LEFT JOIN t_user u ON c.user_id = u.user_id
    UNION ALL
    SELECT 'worklogs', w.issue_id, w.worklog_id, u.username,
      CAST(row_number() OVER (PARTITION BY w.issue_id ORDER BY w.work_date DESC NULLS LAST, w.created_at DESC NULLS LAST, w.worklog_id) - 1 AS INT)
    FROM t_worklog w LEFT JOIN t_user u ON w.user_id = u.user_id
    UNION ALL
    SELECT 'attachments', a.issue_id, a.attachment_id, u.username,
      CAST(row_number() OVER (PARTITION BY a.issue_id ORDER BY a.uploaded_at DESC NULLS LAST, a.attachment_id) - 1 AS INT)
    FROM t_attachment a LEFT JOIN t_user u ON a.user_id = u.user_id
  ) WHERE pos < 100
) x ON x.issue_id = e.issue_id AND x.kind = k.kind
""")

sql("page_project_issues_keyset", f"""
SELECT * FROM ({ISSUE_ENRICHED}) e
WHERE e.project_id = (SELECT project_id FROM t_issue GROUP BY project_id ORDER BY count(*) DESC, project_id LIMIT 1)
ORDER BY created_date DESC NULLS LAST, issue_id LIMIT 100 OFFSET 100
""")

sql("page_project_issues_deep", f"""
WITH hot AS (SELECT project_id, count(*) AS n FROM t_issue GROUP BY project_id ORDER BY n DESC, project_id LIMIT 1)
SELECT * FROM ({ISSUE_ENRICHED}) e WHERE e.project_id = (SELECT project_id FROM hot)
ORDER BY created_date DESC NULLS LAST, issue_id LIMIT 100 OFFSET (SELECT n // 2 FROM hot)
""")

sql("page_issue_worklogs_deep", """
WITH hot AS (SELECT issue_id, count(*) AS n FROM t_worklog GROUP BY issue_id ORDER BY n DESC, issue_id LIMIT 1)
SELECT worklog_id, issue_id, user_id, hours_logged, work_date FROM t_worklog WHERE issue_id = (SELECT issue_id FROM hot)
ORDER BY work_date DESC NULLS LAST, created_at DESC NULLS LAST, worklog_id LIMIT 100 OFFSET (SELECT n // 2 FROM hot)
""")
