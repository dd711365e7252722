"""Oracle bodies for sources/sinks, the file listing and the streaming roll-ups."""

from .o_core import ISSUE_ENRICHED
from .oracle import sql

sql("base_table_scan", """
SELECT 'user' AS table_name, count(*) AS row_count FROM t_user
UNION ALL SELECT 'project', count(*) FROM t_project
UNION ALL SELECT 'sprint', count(*) FROM t_sprint
UNION ALL SELECT 'issue', count(*) FROM t_issue
UNION ALL SELECT 'comment', count(*) FROM t_comment
UNION ALL SELECT 'attachment', count(*) FROM t_attachment
UNION ALL SELECT 'worklog', count(*) FROM t_worklog
""")

sql("append_rows", """
WITH ok AS (
  SELECT CAST(round_even(r.hours_logged, 2) AS DECIMAL(5,2)) AS hours_logged FROM t_new_worklog r
  WHERE round_even(r.hours_logged, 2) > 0 AND r.hours_logged <= 999.99 AND r.work_date IS NOT NULL
    AND EXISTS (SELECT 1 FROM t_issue i WHERE i.issue_id = r.issue_id)
    AND (r.user_id IS NULL OR EXISTS (SELECT 1 FROM t_user u WHERE u.user_id = r.user_id)))
SELECT (SELECT count(*) FROM t_worklog) + (SELECT count(*) FROM ok) AS row_count,
  CAST((SELECT sum(hours_logged) FROM t_worklog) + COALESCE((SELECT sum(hours_logged) FROM ok), 0) AS DECIMAL(18,2)) AS total_hours
""")

sql("export_json", ISSUE_ENRICHED)

sql("list_files", r"""
SELECT concat(substr(sha256(concat_ws('_', CAST(a.attachment_id AS VARCHAR), a.file_name)), 1, 32), '_',
    CASE WHEN a.file_name IS NULL THEN 'unknown_file'
         WHEN regexp_replace(a.file_name, '[^\p{L}\p{N}._-]', '', 'g') = '' THEN 'attached_file'
         ELSE regexp_replace(a.file_name, '[^\p{L}\p{N}._-]', '', 'g') END) AS stored_name,
  CAST(strlen(COALESCE(b.body, '')) AS BIGINT) AS size_bytes
FROM t_attachment a JOIN t_page_body b ON b.attachment_id = a.attachment_id
""")

sql("stream_issue_last_activity", """
SELECT issue_id, max(ts) AS last_activity FROM t_activity
WHERE kind IN ('comment_insert', 'comment_update', 'worklog_insert', 'attachment_insert') AND ts IS NOT NULL
GROUP BY issue_id
""")

STREAM_HOURS = """
SELECT issue_id, CAST(SUM(CASE kind WHEN 'worklog_insert' THEN hours ELSE -hours END) AS DECIMAL(18,2)) AS total_hours
FROM t_activity WHERE kind IN ('worklog_insert', 'worklog_delete') GROUP BY issue_id
"""

sql("stream_issue_hours", STREAM_HOURS)

sql("stream_issue_hours_keyed", STREAM_HOURS)

_SAFE = r"""CASE WHEN {c} IS NULL THEN 'unknown_file'
         WHEN regexp_replace({c}, '[^\p{{L}}\p{{N}}._-]', '', 'g') = '' THEN 'attached_file'
         ELSE regexp_replace({c}, '[^\p{{L}}\p{{N}}._-]', '', 'g') END"""

ORPHANS = f"""
SELECT concat(substr(sha256(concat_ws('_', CAST(a.attachment_id AS VARCHAR), a.file_name)), 1, 32), '_',
    {_SAFE.format(c="a.file_name")}) AS stored_name,
  CAST(strlen(COALESCE(b.body, '')) AS BIGINT) AS size_bytes
FROM t_attachment a JOIN t_page_body b ON b.attachment_id = a.attachment_id
JOIN t_issue i ON i.issue_id = a.issue_id
WHERE i.project_id IN (SELECT project_id FROM t_project WHERE project_id IN (SELECT pk FROM t_delete_project))
"""

sql("orphan_files", ORPHANS)

MISSING = f"""
SELECT CAST((SELECT max(attachment_id) FROM t_attachment) + row_number() OVER (ORDER BY n.request_id) AS BIGINT) AS attachment_id,
  n.issue_id,
  concat(substr(sha256(concat_ws('_', CAST(n.request_id AS VARCHAR), n.file_name)), 1, 32), '_',
    {_SAFE.format(c="n.file_name")}) AS file_path
FROM t_new_attachment n
WHERE EXISTS (SELECT 1 FROM t_issue i WHERE i.issue_id = n.issue_id)
  AND (n.user_id IS NULL OR EXISTS (SELECT 1 FROM t_user u WHERE u.user_id = n.user_id))
"""

sql("missing_files", MISSING)

sql("stream_file_audit", f"""
SELECT 'orphan_file' AS kind, stored_name, size_bytes, CAST(NULL AS BIGINT) AS attachment_id, CAST(NULL AS INTEGER) AS issue_id FROM ({ORPHANS})
UNION ALL SELECT 'missing_file', file_path, NULL, attachment_id, issue_id FROM ({MISSING})
""")
