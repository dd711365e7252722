"""Stand-in tracker tables built from the driver's test tables.

The driver ships TPC-H-like tables. These views only reshape them into the
tracker schema (users from customers, issues from orders, worklogs from line
items, ...) and into change batches (status changes, sprint requests, ...). They do
none of any operator's work. The same SQL text runs in Spark (tables bound as
DataFrame parameters of ``spark.sql``) and in DuckDB (as CTEs of the oracle), so
both engines see identical inputs.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("customer", "nation", "orders", "lineitem", "conversations", "pages", "events")

# Ordered: a view may use the views above it.
VIEWS: dict[str, str] = {
    "t_user": """
SELECT CAST(c_custkey AS INT) AS user_id, c_name AS username,
  concat(lower(c_name), '@example.com') AS email, concat('hash', CAST(c_custkey AS VARCHAR(20))) AS password_hash,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS first_name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('N', CAST(c_nationkey AS VARCHAR(10))) END AS last_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('+1-555-', CAST(c_custkey AS VARCHAR(10))) END AS phone,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'project_manager' ELSE 'user' END AS role,
  CAST(TIMESTAMP '1994-01-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE AS TIMESTAMP) AS created_at
FROM {customer}""",
    "t_project": """
SELECT CAST(n_nationkey AS INT) AS project_id, upper(replace(n_name, '_', '')) AS project_key,
  n_name AS project_name,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE concat('Work for ', n_name) END AS description,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(DATE '1995-01-01' + n_nationkey * INTERVAL '1' DAY AS DATE) END AS start_date,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(DATE '1999-01-01' + n_nationkey * INTERVAL '1' DAY AS DATE) END AS end_date,
  CASE n_regionkey WHEN 0 THEN 'planning' WHEN 1 THEN 'active' WHEN 2 THEN 'active' WHEN 3 THEN 'completed' ELSE 'archived' END AS status,
  CASE WHEN n_nationkey % 10 = 9 THEN NULL ELSE CAST(n_nationkey * 5 AS INT) END AS owner_id,
  CAST(TIMESTAMP '1994-06-01 00:00:00' + (n_nationkey % 6) * INTERVAL '1' DAY AS TIMESTAMP) AS created_at,
  CAST(TIMESTAMP '1994-06-01 00:00:00' + (n_nationkey % 6) * INTERVAL '1' DAY AS TIMESTAMP) AS updated_at
FROM {nation}""",
    "t_sprint": """
SELECT DISTINCT CAST((o_custkey % 25) * 10 + year(o_orderdate) - 1995 AS INT) AS sprint_id,
  CAST(o_custkey % 25 AS INT) AS project_id,
  concat('Sprint ', CAST(year(o_orderdate) AS VARCHAR(10))) AS sprint_name,
  CASE WHEN year(o_orderdate) % 2 = 0 THEN NULL ELSE concat('Goal of ', CAST(year(o_orderdate) AS VARCHAR(10))) END AS goal,
  CASE WHEN year(o_orderdate) = 1998 THEN NULL ELSE CAST(date_trunc('year', o_orderdate) AS DATE) END AS start_date,
  CASE WHEN year(o_orderdate) = 1998 THEN NULL ELSE CAST(date_trunc('year', o_orderdate) + INTERVAL '13' DAY AS DATE) END AS end_date,
  CASE WHEN year(o_orderdate) < 2000 THEN 'completed' WHEN year(o_orderdate) = 2000 THEN 'active' ELSE 'future' END AS status,
  CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS created_at,
  CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS updated_at
FROM {orders}""",
    "t_issue": """
SELECT CAST(o_orderkey AS INT) AS issue_id, CAST(o_custkey % 25 AS INT) AS project_id,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST((o_custkey % 25) * 10 + year(o_orderdate) - 1995 AS INT) END AS sprint_id,
  concat('Order ', CAST(o_orderkey AS VARCHAR(20)), ' raised by customer ', CAST(o_custkey AS VARCHAR(20)), ' with priority ', o_orderpriority) AS description,
  CASE o_orderkey % 4 WHEN 0 THEN 'Epic' WHEN 1 THEN 'Task' WHEN 2 THEN 'Bug' ELSE 'Story' END AS issue_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Highest' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN 'Low' ELSE 'Lowest' END AS priority,
  CASE WHEN o_orderstatus = 'F' THEN 'Done' WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'In Review' WHEN o_orderstatus = 'P' THEN 'In Progress' WHEN o_orderkey % 7 = 0 THEN 'Blocked' ELSE 'To Do' END AS status,
  CAST(o_custkey AS INT) AS reporter_id,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 150 AS INT) END AS assignee_id,
  CAST(o_orderdate AS TIMESTAMP) AS created_date,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate + INTERVAL '30' DAY AS DATE) END AS due_date,
  CAST(o_orderdate AS TIMESTAMP) AS updated_date,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 13 AS INT) END AS story_points,
  CASE WHEN o_orderkey % 8 = 1 THEN CAST(o_orderkey - 1 AS INT) END AS parent_issue_id
FROM {orders}""",
    # Line items carry no id of their own; (order, ship date, part, line) is unique
    # in the driver data, so a per-order sequence over it gives a stable id.
    "t_worklog": """
SELECT CAST(CAST(issue_id AS BIGINT) * 1000000 + row_number() OVER (PARTITION BY issue_id ORDER BY created_at, src_partkey, src_line) AS BIGINT) AS worklog_id,
  issue_id, user_id, hours_logged, work_date, description, created_at, src_partkey, src_line
FROM (
  SELECT CAST(l_orderkey AS INT) AS issue_id,
    CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE CAST(l_suppkey AS INT) END AS user_id,
    CAST(l_quantity AS DECIMAL(5,2)) AS hours_logged, CAST(l_shipdate AS DATE) AS work_date,
    CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Shipped part ', CAST(l_partkey AS VARCHAR(20))) END AS description,
    CAST(l_shipdate AS TIMESTAMP) AS created_at,
    l_partkey AS src_partkey, l_linenumber AS src_line
  FROM {lineitem}) x""",
    "t_comment": """
SELECT CAST(CAST(conv_id AS BIGINT) * 1000000 + turn AS BIGINT) AS comment_id, CAST(conv_id AS INT) AS issue_id,
  CASE role WHEN 'system' THEN NULL WHEN 'user' THEN CAST(conv_id % 100 AS INT) ELSE CAST((conv_id + 1) % 100 AS INT) END AS user_id,
  text AS comment_text,
  CAST(TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS TIMESTAMP) AS created_at,
  CASE WHEN turn % 3 = 2 THEN CAST(TIMESTAMP '2024-01-01 00:30:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS TIMESTAMP) END AS updated_at
FROM {conversations}""",
    "t_attachment": """
SELECT CAST(page_id AS INT) AS attachment_id, CAST(page_id % 100 AS INT) AS issue_id,
  CASE WHEN page_id % 9 = 0 THEN NULL ELSE CAST(page_id % 150 AS INT) END AS user_id,
  url AS file_name, concat(CAST(page_id AS VARCHAR(20)), '_', url) AS file_path,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'text/html' END AS file_type,
  CAST(length(html) AS BIGINT) AS file_size_bytes,
  CAST(TIMESTAMP '2024-02-01 00:00:00' + page_id * INTERVAL '1' HOUR AS TIMESTAMP) AS uploaded_at
FROM {pages}""",
    # Bodies of the uploaded files (one per attachment).
    "t_page_body": """
SELECT CAST(page_id AS INT) AS attachment_id, html AS body FROM {pages}""",
    # Change batches: what users did after the snapshot.
    "t_activity": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id AS INT) AS user_id, CAST(event_id % 1500 AS INT) AS issue_id,
  CASE event_type WHEN 'click' THEN 'comment_insert' WHEN 'view' THEN 'comment_update' WHEN 'purchase' THEN 'worklog_insert' WHEN 'signup' THEN 'attachment_insert' ELSE CASE WHEN event_id % 2 = 0 THEN 'worklog_delete' ELSE 'worklog_update' END END AS kind,
  CAST(value AS DECIMAL(5,2)) AS hours
FROM {events}""",
    # The same events as a stream delivers them: some come twice.
    "t_activity_delivered": """
SELECT event_id, ts, user_id, issue_id, kind, hours FROM {t_activity}
UNION ALL SELECT event_id, ts, user_id, issue_id, kind, hours FROM {t_activity} WHERE event_id % 20 < 2""",
    "t_sprint_request": """
SELECT CAST(e.event_id AS INT) AS request_id, CAST(e.event_id % 2000 AS INT) AS issue_id,
  CASE e.event_type WHEN 'error' THEN NULL WHEN 'click' THEN 99999 WHEN 'view' THEN CAST((e.event_id % 25) * 10 + e.user_id % 7 AS INT) ELSE CAST((o.o_custkey % 25) * 10 + e.user_id % 7 AS INT) END AS sprint_id
FROM {events} e LEFT JOIN {orders} o ON o.o_orderkey = e.event_id % 2000""",
    "t_status_change": """
SELECT event_id AS change_id, CAST(event_id % 2000 AS INT) AS issue_id,
  CASE event_type WHEN 'click' THEN 'In Progress' WHEN 'view' THEN 'In Review' WHEN 'purchase' THEN 'Done' WHEN 'signup' THEN 'Blocked' ELSE 'Archived' END AS status
FROM {events}""",
    "t_assignment": """
SELECT event_id AS change_id, CAST(event_id % 2000 AS INT) AS issue_id,
  CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN CAST(user_id + 100000 AS INT) ELSE CAST(user_id AS INT) END AS assignee_id
FROM {events}""",
    "t_issue_patch": """
SELECT event_id AS change_id, CAST(event_id % 2000 AS INT) AS pk,
  split(CASE event_type WHEN 'click' THEN 'priority' WHEN 'view' THEN 'due_date,status' WHEN 'purchase' THEN 'story_points,description' WHEN 'signup' THEN 'parent_issue_id,issue_type' ELSE 'assignee_id,sprint_id' END, ',') AS set_fields,
  concat('Edited by user ', CAST(user_id AS VARCHAR(10))) AS description,
  CASE WHEN user_id % 2 = 0 THEN 'Bug' ELSE 'Story' END AS issue_type,
  CASE WHEN value > 100 THEN 'Highest' WHEN user_id % 9 = 1 THEN 'Urgent' ELSE 'Low' END AS priority,
  CAST(NULL AS DATE) AS due_date,
  CAST(user_id % 13 - 1 AS INT) AS story_points,
  CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 7 = 1 THEN 987654321 ELSE CAST(event_id % 2000 + 1 AS INT) END AS parent_issue_id,
  'Done' AS status, CAST(user_id AS INT) AS assignee_id, CAST(NULL AS INT) AS sprint_id
FROM {events}""",
    # Patches of the other tables: fields set to good and bad values and to null.
    "t_user_patch": """
SELECT event_id AS change_id, CAST(event_id % 170 AS INT) AS pk,
  split(CASE event_type WHEN 'click' THEN 'email' WHEN 'view' THEN 'phone,first_name' WHEN 'purchase' THEN 'first_name,role' ELSE 'last_name' END, ',') AS set_fields,
  CASE WHEN event_id % 5 = 0 THEN concat('CUSTOMER#', lpad(CAST(user_id % 150 AS VARCHAR(10)), 9, '0'), '@example.com') WHEN event_id % 5 = 1 THEN 'nowhere' ELSE concat('new', CAST(event_id AS VARCHAR(20)), '@example.org') END AS email,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('F', CAST(user_id AS VARCHAR(10))) END AS first_name,
  CASE WHEN user_id % 9 = 0 THEN repeat('l', 101) ELSE 'Lee' END AS last_name,
  CASE WHEN user_id % 3 = 0 THEN repeat('1', 21) ELSE '555' END AS phone, 'admin' AS role
FROM {events}""",
    "t_project_patch": """
SELECT event_id AS change_id, CAST(event_id % 27 AS INT) AS pk,
  split(CASE event_type WHEN 'click' THEN 'owner_id' WHEN 'view' THEN 'status' WHEN 'purchase' THEN 'project_name,project_key' ELSE 'end_date,description' END, ',') AS set_fields,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('Plan ', CAST(user_id % 3 AS VARCHAR(10))) END AS project_name,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'Described' END AS description, CAST(NULL AS DATE) AS end_date,
  CASE user_id % 4 WHEN 0 THEN 'paused' WHEN 1 THEN 'active' ELSE 'completed' END AS status,
  CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN 987654 ELSE CAST(user_id % 100 AS INT) END AS owner_id, 'KEY' AS project_key
FROM {events}""",
    "t_sprint_patch": """
SELECT event_id AS change_id, CAST(event_id % 250 AS INT) AS pk,
  split(CASE event_type WHEN 'click' THEN 'sprint_name' WHEN 'view' THEN 'status,project_id' ELSE 'goal' END, ',') AS set_fields,
  CASE user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Sprint ', CAST(1995 + user_id % 4 AS VARCHAR(10))) END AS sprint_name,
  CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'A goal' END AS goal,
  CASE user_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'future' ELSE 'completed' END AS status, CAST(1 AS INT) AS project_id
FROM {events}""",
    "t_worklog_patch": """
SELECT event_id AS change_id, CAST(event_id % 500 AS BIGINT) * 1000000 + 1 AS pk,
  split(CASE event_type WHEN 'click' THEN 'hours_logged' WHEN 'view' THEN 'work_date' ELSE 'description,hours_logged' END, ',') AS set_fields,
  CAST(CASE event_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 0.004 WHEN 2 THEN 0.125 WHEN 3 THEN 999.99 WHEN 4 THEN 1000 WHEN 5 THEN NULL ELSE user_id % 20 + 1 END AS DECIMAL(20,6)) AS hours_logged,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS work_date, CAST(NULL AS STRING) AS description
FROM {events}""",
    "t_comment_patch": """
SELECT event_id AS change_id, CAST(event_id % 200 AS BIGINT) * 1000000 + 1 AS pk, split('comment_text,user_id', ',') AS set_fields,
  CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Edit ', CAST(user_id % 3 AS VARCHAR(10))) END AS comment_text, CAST(1 AS INT) AS user_id
FROM {events}""",
    "t_new_worklog": """
SELECT event_id AS request_id, issue_id, user_id,
  CAST(CASE event_id % 50 WHEN 1 THEN 0 WHEN 2 THEN 0.004 WHEN 3 THEN 0.125 WHEN 4 THEN 999.99 WHEN 5 THEN 1000.00 WHEN 6 THEN NULL ELSE hours END AS DECIMAL(20,6)) AS hours_logged,
  CAST(ts AS DATE) AS work_date,
  CAST(NULL AS STRING) AS description
FROM {t_activity} WHERE kind = 'worklog_insert'""",
    "t_new_comment": """
SELECT event_id AS request_id, issue_id, user_id, concat('Comment by user ', CAST(user_id AS VARCHAR(10))) AS comment_text
FROM {t_activity} WHERE kind = 'comment_insert'""",
    # Sign-ups: taken names and emails, names and emails that several requests of the batch
    # want, and requests that are refused for one key while their other key is free.
    "t_new_user": """
SELECT event_id AS request_id,
  CASE event_type WHEN 'signup' THEN c.c_name WHEN 'view' THEN concat('Fresh', CAST(event_id % 40 AS VARCHAR(20))) WHEN 'click' THEN concat('FRESH', CAST(event_id % 40 AS VARCHAR(20))) WHEN 'error' THEN 'ab' ELSE concat('Member', CAST(event_id AS VARCHAR(20))) END AS username,
  CASE WHEN event_type = 'click' THEN concat(lower(c.c_name), '@example.com') WHEN event_type = 'view' AND event_id % 2 = 0 THEN concat('fresh', CAST(event_id % 30 AS VARCHAR(20)), '@example.org') WHEN event_id % 17 = 0 THEN 'no address' ELSE concat('m', CAST(event_id AS VARCHAR(20)), '@example.org') END AS email,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat('hash', CAST(event_id AS VARCHAR(20))) END AS password_hash,
  CAST(NULL AS STRING) AS first_name, CAST(NULL AS STRING) AS last_name, CAST(NULL AS STRING) AS phone,
  'admin' AS role
FROM {events} e LEFT JOIN {customer} c ON c.c_custkey = e.user_id""",
    "t_new_issue": """
SELECT event_id AS request_id, CAST(event_id % 27 AS INT) AS project_id,
  CASE event_type WHEN 'click' THEN CAST((event_id % 27) * 10 + event_id % 4 AS INT) WHEN 'view' THEN CAST((event_id % 25) * 10 + 1 AS INT) END AS sprint_id,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 4000 AS INT) END AS parent_issue_id,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('Issue of event ', CAST(event_id AS VARCHAR(20))) END AS description,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'Wish' ELSE 'Bug' END AS issue_type,
  CAST(event_id % 9 - 1 AS INT) AS story_points, 'Done' AS status,
  CAST(user_id AS INT) AS reporter_id, CAST(user_id % 200 AS INT) AS assignee_id
FROM {events}""",
    # Project keys: taken ones, keys that several requests want, bad ones.
    "t_new_project": """
SELECT event_id AS request_id,
  CASE event_type WHEN 'click' THEN concat('K', CAST(event_id % 300 AS VARCHAR(10))) WHEN 'view' THEN 'FRANCE' WHEN 'purchase' THEN concat('P', CAST(event_id AS VARCHAR(20))) WHEN 'signup' THEN 'lower' END AS project_key,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('Plan ', CAST(event_id AS VARCHAR(20))) END AS project_name,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'Asked for' END AS description, CAST(ts AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date, 'active' AS status,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id AS INT) END AS owner_id
FROM {events}""",
    "t_new_sprint": """
SELECT event_id AS request_id, CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(event_id % 27 AS INT) END AS project_id,
  CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN repeat('s', 256) ELSE concat('Sprint ', CAST(event_id AS VARCHAR(20))) END AS sprint_name,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'A goal' END AS goal, CAST(ts AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date,
  CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'open' WHEN 'signup' THEN 'completed' END AS status
FROM {events}""",
    # A mixed log: changes of rows of the snapshot and of rows the log itself inserts, chains
    # of issues under one another, deletes of parents in between.
    "t_change_log": """
SELECT event_id AS change_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE WHEN event_id % 20 IN (0, 1, 2, 3, 4, 5, 6, 7, 8) THEN 'issue' WHEN event_id % 20 IN (9, 10, 11) THEN 'comment' WHEN event_id % 20 IN (12, 13, 14) THEN 'worklog'
    WHEN event_id % 20 IN (15, 16, 17) THEN 'sprint' WHEN event_id % 20 = 18 THEN 'user' ELSE 'project' END AS table_name,
  CASE WHEN event_id % 20 IN (1, 2, 9, 12, 15) THEN 'insert' WHEN event_id % 20 IN (0, 11, 14, 17) THEN 'delete' WHEN event_id % 20 IN (3, 4, 10, 13, 16) THEN 'patch'
    WHEN event_id % 20 IN (5, 6) THEN 'status' WHEN event_id % 20 = 7 THEN 'assign' WHEN event_id % 20 = 8 THEN 'sprint' WHEN event_id % 20 = 18 THEN 'delete'
    WHEN event_id % 400 = 399 THEN 'delete' ELSE 'merge' END AS action,
  CASE WHEN event_id % 20 IN (1, 2, 9, 12, 15) THEN 100000000 + event_id
    WHEN event_id % 20 IN (0, 3, 4, 5, 6, 7, 8) THEN CASE WHEN user_id % 3 = 0 THEN 100000000 + event_id - event_id % 20 - 19 + 20 * (user_id % 2) ELSE event_id * 7 % 600 END
    WHEN event_id % 20 IN (10, 11) THEN CASE WHEN user_id % 3 = 0 THEN 100000000 + event_id - event_id % 20 - 11 ELSE (event_id % 90) * 1000000 + event_id % 4 END
    WHEN event_id % 20 IN (13, 14) THEN CASE WHEN user_id % 3 = 0 THEN 100000000 + event_id - event_id % 20 - 8 ELSE (event_id % 500) * 1000000 + 1 END
    WHEN event_id % 20 IN (16, 17) THEN CASE WHEN user_id % 3 = 0 THEN 100000000 + event_id - event_id % 20 - 5 ELSE event_id % 250 END
    WHEN event_id % 20 = 18 THEN event_id % 200 ELSE event_id % 30 END AS pk,
  split(CASE event_id % 20 WHEN 3 THEN 'description,status' WHEN 4 THEN 'story_points,parent_issue_id' WHEN 10 THEN 'comment_text' WHEN 13 THEN 'hours_logged' ELSE 'goal' END, ',') AS set_fields,
  CAST(floor(event_id / 40) % 25 AS INT) AS project_id,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN CAST((floor(event_id / 40) % 25) * 10 + event_id % 4 AS INT) ELSE CAST(event_id % 260 AS INT) END AS sprint_id,
  CASE event_id % 20 WHEN 1 THEN CASE WHEN event_id % 200 < 20 THEN NULL ELSE CAST(100000000 + event_id - 19 AS INT) END WHEN 2 THEN CAST(100000000 + event_id - 1 AS INT)
    ELSE CASE WHEN user_id % 2 = 0 THEN CAST(event_id % 700 AS INT) END END AS parent_issue_id,
  CASE WHEN user_id % 2 = 0 THEN CAST(100000000 + event_id - event_id % 20 + 1 AS INT) ELSE CAST(event_id * 7 % 600 AS INT) END AS issue_id,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id % 160 AS INT) END AS user_id, CAST(user_id % 150 AS INT) AS reporter_id,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id % 160 AS INT) END AS assignee_id,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('Text ', CAST(user_id % 3 AS VARCHAR(10))) END AS description,
  CASE event_type WHEN 'click' THEN 'In Progress' WHEN 'view' THEN 'In Review' WHEN 'purchase' THEN 'Done' WHEN 'signup' THEN 'Blocked' ELSE 'Archived' END AS status,
  CAST(user_id % 6 - 1 AS INT) AS story_points, 'Sprint of the log' AS sprint_name, CASE WHEN user_id % 2 = 0 THEN 'A goal' END AS goal,
  CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'Noted' ELSE 'NOTED' END AS comment_text,
  CAST(user_id % 9 AS DECIMAL(20,6)) AS hours_logged, CAST(ts AS DATE) AS work_date
FROM {events}""",
    "t_late_issue": """
SELECT issue_id AS pk FROM {t_issue} WHERE issue_id > 900""",
    "t_new_attachment": """
SELECT event_id AS request_id, issue_id, user_id, concat('upload_', CAST(event_id AS VARCHAR(20)), '.txt') AS file_name,
  'text/plain' AS file_type, CAST(hours * 100 AS BIGINT) AS file_size_bytes
FROM {t_activity} WHERE kind = 'attachment_insert'""",
    "t_delete_project": """
SELECT project_id AS pk FROM {t_project} WHERE status = 'archived'""",
    "t_delete_user": """
SELECT user_id AS pk FROM {t_user} WHERE role = 'project_manager'""",
    # Keys that lookups and deletes ask for, some of which exist in each table.
    "t_some_key": """
SELECT DISTINCT CAST(pk AS BIGINT) AS pk FROM (
  SELECT event_id % 700 AS pk FROM {events} UNION ALL SELECT CAST(event_id % 700 AS BIGINT) * 1000000 + 1 FROM {events}) x""",
    # The tables with bad rows in them: every rule of the validity checks meets some.
    "t_dirty_user": """
SELECT CASE WHEN user_id % 97 = 1 THEN NULL ELSE user_id END AS user_id,
  CASE user_id % 41 WHEN 0 THEN NULL WHEN 1 THEN 'ab' WHEN 2 THEN repeat('x', 256) WHEN 3 THEN 'TWIN name' WHEN 4 THEN 'twin NAME' ELSE username END AS username,
  CASE user_id % 43 WHEN 0 THEN NULL WHEN 1 THEN 'no address' WHEN 2 THEN concat(repeat('y', 250), '@example.com') WHEN 3 THEN 'Twin@example.com' WHEN 4 THEN 'a b@example.com' WHEN 5 THEN 'x@nodot' ELSE email END AS email,
  CASE WHEN user_id % 29 = 0 THEN NULL ELSE password_hash END AS password_hash,
  CASE WHEN user_id % 37 = 0 THEN repeat('f', 101) ELSE first_name END AS first_name,
  CASE WHEN user_id % 37 = 1 THEN repeat('l', 101) ELSE last_name END AS last_name,
  CASE WHEN user_id % 37 = 2 THEN repeat('5', 21) ELSE phone END AS phone,
  CASE user_id % 31 WHEN 0 THEN NULL WHEN 1 THEN 'owner' ELSE role END AS role, created_at
FROM {t_user}""",
    "t_dirty_project": """
SELECT project_id, CASE project_id WHEN 1 THEN NULL WHEN 2 THEN 'lower' WHEN 3 THEN 'ELEVENCHARS' WHEN 4 THEN 'TWIN' WHEN 5 THEN 'TWIN' ELSE project_key END AS project_key,
  CASE project_id WHEN 6 THEN NULL WHEN 7 THEN '' WHEN 8 THEN repeat('p', 256) ELSE project_name END AS project_name, description, start_date, end_date,
  CASE project_id WHEN 9 THEN NULL WHEN 10 THEN 'paused' ELSE status END AS status,
  CASE WHEN project_id = 11 THEN 987654 ELSE owner_id END AS owner_id, created_at, updated_at
FROM {t_project}""",
    "t_dirty_sprint": """
SELECT sprint_id, CASE sprint_id % 23 WHEN 0 THEN NULL WHEN 1 THEN 987654 ELSE project_id END AS project_id,
  CASE sprint_id % 19 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN repeat('s', 256) ELSE sprint_name END AS sprint_name, goal, start_date, end_date,
  CASE sprint_id % 17 WHEN 0 THEN NULL WHEN 1 THEN 'open' ELSE status END AS status, created_at, updated_at
FROM {t_sprint}""",
    "t_dirty_issue": """
SELECT issue_id, CASE issue_id % 101 WHEN 0 THEN NULL WHEN 1 THEN 987654 ELSE project_id END AS project_id,
  CASE issue_id % 103 WHEN 0 THEN 987654 WHEN 1 THEN 11 ELSE sprint_id END AS sprint_id,
  CASE issue_id % 59 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE description END AS description,
  CASE issue_id % 61 WHEN 0 THEN NULL WHEN 1 THEN 'Wish' ELSE issue_type END AS issue_type,
  CASE issue_id % 67 WHEN 0 THEN NULL WHEN 1 THEN 'Urgent' ELSE priority END AS priority,
  CASE issue_id % 71 WHEN 0 THEN NULL WHEN 1 THEN 'Open' ELSE status END AS status,
  CASE WHEN issue_id % 73 = 0 THEN 987654 ELSE reporter_id END AS reporter_id, assignee_id, created_date, due_date, updated_date,
  CASE WHEN issue_id % 79 = 0 THEN -1 ELSE story_points END AS story_points,
  CASE issue_id % 83 WHEN 0 THEN 987654 WHEN 1 THEN issue_id - 1 ELSE parent_issue_id END AS parent_issue_id
FROM {t_issue}""",
    "t_dirty_comment": """
SELECT comment_id, CASE comment_id % 29 WHEN 0 THEN NULL WHEN 1 THEN 987654321 ELSE issue_id END AS issue_id,
  CASE WHEN comment_id % 31 = 0 THEN 987654 ELSE user_id END AS user_id,
  CASE comment_id % 37 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE comment_text END AS comment_text, created_at, updated_at
FROM {t_comment}""",
    "t_dirty_attachment": """
SELECT attachment_id, CASE attachment_id % 29 WHEN 0 THEN NULL WHEN 1 THEN 987654321 ELSE issue_id END AS issue_id, user_id,
  CASE attachment_id % 23 WHEN 0 THEN NULL WHEN 1 THEN repeat('n', 256) ELSE file_name END AS file_name,
  CASE attachment_id % 19 WHEN 0 THEN NULL WHEN 1 THEN repeat('q', 513) WHEN 2 THEN 'Same/Path' WHEN 3 THEN 'same/PATH' ELSE file_path END AS file_path,
  CASE WHEN attachment_id % 17 = 0 THEN repeat('t', 101) ELSE file_type END AS file_type,
  CASE WHEN attachment_id % 13 = 0 THEN -1 ELSE file_size_bytes END AS file_size_bytes, uploaded_at
FROM {t_attachment}""",
    # Hours come unrounded here, as a request carries them.
    "t_dirty_worklog": """
SELECT worklog_id, CASE worklog_id % 89 WHEN 0 THEN NULL WHEN 1 THEN 987654321 ELSE issue_id END AS issue_id,
  CASE WHEN worklog_id % 97 = 0 THEN 98765432 ELSE user_id END AS user_id,
  CAST(CASE worklog_id % 53 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0.004 WHEN 3 THEN 1000 WHEN 4 THEN -2 WHEN 5 THEN 0.125 ELSE hours_logged END AS DECIMAL(20,6)) AS hours_logged,
  CASE WHEN worklog_id % 47 = 0 THEN NULL ELSE work_date END AS work_date, description, created_at
FROM {t_worklog}""",
}

# Name in the result dict of ``fixture_tables`` for each view.
SHORT = {name: name.removeprefix("t_") for name in VIEWS}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def view_deps(name: str) -> list[str]:
    """Views (not driver tables) a view reads."""
    return [d for d in _PLACEHOLDER.findall(VIEWS[name]) if d in VIEWS]


class _LazyViews(Mapping):
    """``{short name: DataFrame}`` whose views are planned on first access, so a
    query pays only for the stand-in tables it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str, names: list[str]):
        self._spark, self._dir = spark, sf_dir
        self._names = names
        self._raw: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._raw[name]

    def _view(self, name: str) -> DataFrame:
        if name not in self._built:
            sql = VIEWS[name]
            args = {dep: (self._view(dep) if dep in VIEWS else self._table(dep))
                    for dep in set(_PLACEHOLDER.findall(sql))}
            self._built[name] = self._spark.sql(sql, **args)
        return self._built[name]

    def __getitem__(self, short: str) -> DataFrame:
        view = f"t_{short}"
        if view not in self._names:
            raise KeyError(short)
        return self._view(view)

    def __iter__(self):
        return (SHORT[v] for v in self._names)

    def __len__(self) -> int:
        return len(self._names)


_LOADED: dict[tuple, _LazyViews] = {}


def fixture_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> Mapping[str, DataFrame]:
    """The stand-in tables for ``sf_dir`` as lazily planned DataFrames:
    ``{"user": df, "issue": df, ..., "sprint_request": df, ...}``.

    Loaded once per session and folder (as a Spark user loads tables once and
    reuses the DataFrames); only plans are kept, no data is cached."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _LOADED:
        _LOADED[key] = _LazyViews(spark, sf_dir, list(VIEWS))
    views = _LOADED[key]
    if not names:
        return views
    return {n: views[n] for n in names}


def oracle_with(body: str) -> str:
    """Prefix an oracle query with the CTEs of every ``t_*`` view it uses."""
    needed: list[str] = []

    def add(name: str) -> None:
        for dep in view_deps(name):
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            add(name)
    if not needed:
        return body
    ctes = ",\n".join(
        f"{name} AS ({_PLACEHOLDER.sub(lambda m: m.group(1), VIEWS[name]).strip()})" for name in needed
    )
    text = body.strip()
    if re.match(r"(?i)^with\s+recursive\s", text):
        return f"WITH RECURSIVE {ctes},\n{re.sub(r'(?i)^with\s+recursive\s+', '', text)}"
    if re.match(r"(?i)^with\s", text):
        return f"WITH {ctes},\n{text[5:].lstrip()}"
    return f"WITH {ctes}\n{text}"
