"""Oracle bodies for display and clean-up columns."""

from .o_core import ISSUE_ENRICHED, ISSUE_HOURS
from .oracle import sql

sql("issue_code", f"SELECT issue_id, concat_ws('-', project_key, CAST(issue_id AS VARCHAR)) AS issue_code FROM ({ISSUE_ENRICHED}) e")

sql("short_description", """
SELECT issue_id, CASE WHEN length(description) > 50 THEN concat(substr(description, 1, 50), '...') ELSE description END AS short_description
FROM t_issue""")

sql("parent_label", f"""
SELECT issue_id, concat(project_key, '-', CAST(issue_id AS VARCHAR), ' (', substr(description, 1, 30), '...)') AS parent_label
FROM ({ISSUE_ENRICHED}) e""")

sql("fallback_labels", f"""
SELECT issue_id,
  CASE WHEN assignee_username IS NULL OR assignee_username = '' THEN 'Unassigned' ELSE assignee_username END AS assignee_label,
  CASE WHEN sprint_name IS NULL OR sprint_name = '' THEN 'Backlog' ELSE sprint_name END AS sprint_label,
  CASE WHEN reporter_username IS NULL OR reporter_username = '' THEN 'Unknown' ELSE reporter_username END AS reporter_label,
  CASE WHEN story_points IS NULL OR story_points = 0 THEN 'Not set' ELSE CAST(story_points AS VARCHAR) END AS story_points_label
FROM ({ISSUE_ENRICHED}) e""")

sql("worklog_labels", """
SELECT w.worklog_id,
  CASE WHEN u.username IS NULL OR u.username = '' THEN 'Unknown' ELSE u.username END AS logger_label,
  CASE WHEN w.description IS NULL OR w.description = '' THEN 'No description.' ELSE w.description END AS description_label,
  CAST(CAST(w.hours_logged AS DECIMAL(18,2)) AS VARCHAR) AS hours_label,
  COALESCE(strftime(w.work_date, '%b %-d, %Y'), 'N/A') AS work_date_label
FROM t_worklog w LEFT JOIN t_user u ON w.user_id = u.user_id""")

sql("comment_labels", """
SELECT c.comment_id,
  CASE WHEN u.username IS NULL OR u.username = '' THEN 'Unknown User' ELSE u.username END AS author_label,
  COALESCE(strftime(c.created_at, '%b %-d, %Y, %-I:%M %p'), 'N/A') AS created_label
FROM t_comment c LEFT JOIN t_user u ON c.user_id = u.user_id""")

sql("sprint_labels", """
SELECT sprint_id,
  CASE WHEN goal IS NULL OR goal = '' THEN 'No goal set.' ELSE goal END AS goal_label,
  CASE WHEN status IS NULL OR length(status) = 0 THEN '' ELSE concat(upper(substr(status, 1, 1)), substr(status, 2)) END AS status_label,
  COALESCE(strftime(start_date, '%b %-d, %Y'), 'N/A') AS start_label,
  COALESCE(strftime(end_date, '%b %-d, %Y'), 'N/A') AS end_label
FROM t_sprint""")

sql("capitalize", """
SELECT user_id, CASE WHEN role IS NULL OR length(role) = 0 THEN '' ELSE concat(upper(substr(role, 1, 1)), substr(role, 2)) END AS role_label
FROM t_user""")

sql("full_name", "SELECT user_id, concat(COALESCE(first_name, ''), ' ', COALESCE(last_name, '')) AS full_name FROM t_user")

sql("date_label", "SELECT issue_id, COALESCE(strftime(due_date, '%b %-d, %Y'), 'N/A') AS due_label FROM t_issue")

sql("datetime_label", "SELECT issue_id, COALESCE(strftime(created_date, '%b %-d, %Y, %-I:%M %p'), 'N/A') AS created_label FROM t_issue")

sql("hours_label", f"SELECT issue_id, CAST(CAST(total_hours AS DECIMAL(18,2)) AS VARCHAR) AS hours_label FROM ({ISSUE_HOURS}) h")

sql("round_hours", """
SELECT worklog_id, CAST(round_even(hours_logged * CAST(0.25 AS DECIMAL(3,2)), 2) AS DECIMAL(7,2)) AS quarter_hours FROM t_worklog""")

sql("safe_file_name", r"""
SELECT attachment_id,
  CASE WHEN file_name IS NULL THEN 'unknown_file'
       WHEN regexp_replace(file_name, '[^\p{L}\p{N}._-]', '', 'g') = '' THEN 'attached_file'
       ELSE regexp_replace(file_name, '[^\p{L}\p{N}._-]', '', 'g') END AS safe_name
FROM t_attachment""")

sql("stored_path", r"""
SELECT attachment_id,
  concat(substr(sha256(concat_ws('_', CAST(attachment_id AS VARCHAR), file_name)), 1, 32), '_',
    CASE WHEN file_name IS NULL THEN 'unknown_file'
         WHEN regexp_replace(file_name, '[^\p{L}\p{N}._-]', '', 'g') = '' THEN 'attached_file'
         ELSE regexp_replace(file_name, '[^\p{L}\p{N}._-]', '', 'g') END) AS stored_path
FROM t_attachment""")

sql("download_url", """
SELECT attachment_id, concat('/api/attachments/', CAST(attachment_id AS VARCHAR), '/download') AS download_url,
  CASE WHEN file_type IS NULL OR file_type = '' THEN 'application/octet-stream' ELSE file_type END AS media_type
FROM t_attachment""")

sql("blank_to_null", r"""
SELECT worklog_id, NULLIF(description, '') AS description, COALESCE(regexp_matches(description, '[^\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]'), false) AS has_text
FROM t_worklog""")

sql("text_to_int", """
SELECT worklog_id, CASE WHEN worklog_id % 7 <> 0 AND (worklog_id % 4001) * 1000003 <= 2147483647
  THEN TRY_CAST((worklog_id % 4001) * 1000003 AS INT) END AS number
FROM t_worklog
""")
