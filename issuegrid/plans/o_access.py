"""Oracle bodies for visibility and rights."""

from .oracle import sql

OWNER_OF_ISSUE = """
SELECT p.owner_id AS user_id, i.issue_id FROM t_issue i JOIN t_project p ON p.project_id = i.project_id
WHERE p.owner_id IS NOT NULL"""

sql("can_read_issue", f"SELECT DISTINCT * FROM ({OWNER_OF_ISSUE}) o")
sql("can_assign", f"SELECT DISTINCT * FROM ({OWNER_OF_ISSUE}) o")

sql("can_write_issue", f"""
SELECT DISTINCT user_id, issue_id FROM (
  {OWNER_OF_ISSUE}
  UNION ALL SELECT reporter_id, issue_id FROM t_issue WHERE reporter_id IS NOT NULL
  UNION ALL SELECT assignee_id, issue_id FROM t_issue WHERE assignee_id IS NOT NULL) g
""")

sql("can_edit_entry", """
SELECT user_id, 'comment' AS entry_kind, comment_id AS entry_id FROM t_comment WHERE user_id IS NOT NULL
UNION ALL SELECT user_id, 'worklog', worklog_id FROM t_worklog WHERE user_id IS NOT NULL
""")

sql("can_delete_entry", """
WITH e AS (
  SELECT 'comment' AS entry_kind, comment_id AS entry_id, issue_id, user_id FROM t_comment
  UNION ALL SELECT 'worklog', worklog_id, issue_id, user_id FROM t_worklog
  UNION ALL SELECT 'attachment', attachment_id, issue_id, user_id FROM t_attachment)
SELECT DISTINCT user_id, entry_kind, entry_id FROM (
  SELECT user_id, entry_kind, entry_id FROM e WHERE user_id IS NOT NULL
  UNION ALL
  SELECT p.owner_id, e.entry_kind, e.entry_id FROM e JOIN t_issue i ON i.issue_id = e.issue_id
    JOIN t_project p ON p.project_id = i.project_id WHERE p.owner_id IS NOT NULL) g
""")

sql("can_edit_project", "SELECT owner_id AS user_id, project_id FROM t_project WHERE owner_id IS NOT NULL")

sql("admin_users", "SELECT user_id FROM t_user WHERE role = 'admin'")

sql("assignable_users", """
WITH v AS (SELECT DISTINCT a.user_id AS viewer_id, i.project_id FROM t_activity a JOIN t_issue i ON i.issue_id = a.issue_id)
SELECT DISTINCT viewer_id, project_id, user_id FROM (
  SELECT v.viewer_id, v.project_id, v.viewer_id AS user_id FROM v
  UNION ALL SELECT v.viewer_id, v.project_id, p.owner_id FROM v JOIN t_project p ON p.project_id = v.project_id) x
WHERE user_id IS NOT NULL
""")

sql("visible_issues", """
WITH v AS (SELECT owner_id AS viewer FROM t_project WHERE owner_id IS NOT NULL
           GROUP BY owner_id ORDER BY count(*) DESC, owner_id LIMIT 1)
SELECT i.* FROM t_issue i
WHERE EXISTS (SELECT 1 FROM t_user u, v WHERE u.user_id = v.viewer AND u.role = 'admin')
   OR i.project_id IN (SELECT p.project_id FROM t_project p, v WHERE p.owner_id = v.viewer)
""")

sql("visible_users", """
WITH v AS (SELECT min(user_id) AS viewer FROM t_user WHERE role = 'admin')
SELECT u.* EXCLUDE (password_hash) FROM t_user u
WHERE EXISTS (SELECT 1 FROM t_user a, v WHERE a.user_id = v.viewer AND a.role = 'admin')
   OR u.user_id = (SELECT viewer FROM v)
""")

sql("public_users", "SELECT user_id, username, email, first_name, last_name, phone, role FROM t_user")
sql("visible_projects", "SELECT project_id, project_key, project_name, status, owner_id FROM t_project")

sql("visible_users_self", "SELECT user_id, username, role FROM t_user WHERE user_id = (SELECT min(user_id) FROM t_user WHERE role = 'user')")
