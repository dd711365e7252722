"""Table schemas, enumerations, key graph and change allow-lists — all as data.

Everything here is declarative: operators read these structures to build plans
(validation rules, cascades, patches), so adding a column or a foreign key is a
data change, not a code change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S, I, L = T.StringType(), T.IntegerType(), T.LongType()
D, TS = T.DateType(), T.TimestampType()
HOURS = T.DecimalType(5, 2)
# Sums of hours are widened so a whole-tenant total cannot overflow.
HOURS_SUM = T.DecimalType(18, 2)


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


SCHEMAS: dict[str, T.StructType] = {
    "user": T.StructType([
        _f("user_id", I, False), _f("username", S, False), _f("email", S, False),
        _f("password_hash", S, False), _f("first_name", S), _f("last_name", S),
        _f("phone", S), _f("role", S, False), _f("created_at", TS),
    ]),
    "project": T.StructType([
        _f("project_id", I, False), _f("project_key", S, False), _f("project_name", S, False),
        _f("description", S), _f("start_date", D), _f("end_date", D),
        _f("status", S, False), _f("owner_id", I), _f("created_at", TS), _f("updated_at", TS),
    ]),
    "sprint": T.StructType([
        _f("sprint_id", I, False), _f("project_id", I, False), _f("sprint_name", S, False),
        _f("goal", S), _f("start_date", D), _f("end_date", D), _f("status", S, False),
        _f("created_at", TS), _f("updated_at", TS),
    ]),
    "issue": T.StructType([
        _f("issue_id", I, False), _f("project_id", I, False), _f("sprint_id", I),
        _f("description", S, False), _f("issue_type", S, False), _f("priority", S, False),
        _f("status", S, False), _f("reporter_id", I), _f("assignee_id", I),
        _f("created_date", TS), _f("due_date", D), _f("updated_date", TS),
        _f("story_points", I), _f("parent_issue_id", I),
    ]),
    "comment": T.StructType([
        _f("comment_id", L, False), _f("issue_id", I, False), _f("user_id", I),
        _f("comment_text", S, False), _f("created_at", TS), _f("updated_at", TS),
    ]),
    "attachment": T.StructType([
        _f("attachment_id", L, False), _f("issue_id", I, False), _f("user_id", I),
        _f("file_name", S, False), _f("file_path", S, False), _f("file_type", S),
        _f("file_size_bytes", L), _f("uploaded_at", TS),
    ]),
    "worklog": T.StructType([
        _f("worklog_id", L, False), _f("issue_id", I, False), _f("user_id", I),
        _f("hours_logged", HOURS, False), _f("work_date", D, False), _f("description", S),
        _f("created_at", TS),
    ]),
}

TABLES = tuple(SCHEMAS)

PRIMARY_KEYS: dict[str, str] = {
    "user": "user_id", "project": "project_id", "sprint": "sprint_id", "issue": "issue_id",
    "comment": "comment_id", "attachment": "attachment_id", "worklog": "worklog_id",
}

# Columns holding the "last changed" instant that moves on any real change.
AUTO_UPDATE_COLUMNS: dict[str, str] = {
    "project": "updated_at", "sprint": "updated_at", "issue": "updated_date",
    "comment": "updated_at",
}

# --- fixed values: enumerations of the data model (CHECK constraints) ---------
ROLES = ("user", "admin", "project_manager")
PROJECT_STATUSES = ("planning", "active", "completed", "archived")
SPRINT_STATUSES = ("future", "active", "completed")
ISSUE_TYPES = ("Task", "Bug", "Story", "Epic")
PRIORITIES = ("Highest", "High", "Medium", "Low", "Lowest")
ISSUE_STATUSES = ("To Do", "In Progress", "In Review", "Done", "Blocked")

# (table, column) -> allowed values
ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("user", "role"): ROLES,
    ("project", "status"): PROJECT_STATUSES,
    ("sprint", "status"): SPRINT_STATUSES,
    ("issue", "issue_type"): ISSUE_TYPES,
    ("issue", "priority"): PRIORITIES,
    ("issue", "status"): ISSUE_STATUSES,
}

# --- fixed values: defaults forced on insert ---------------------------------
INSERT_DEFAULTS: dict[str, dict[str, object]] = {
    "user": {"role": "user"},
    "project": {"status": "planning", "start_date": None, "end_date": None},
    "issue": {"status": "To Do"},
    "sprint": {},
    "comment": {},
    "worklog": {},
    "attachment": {},
}
COLUMN_DEFAULTS: dict[str, dict[str, object]] = {
    "issue": {"issue_type": "Task", "priority": "Medium"},
    "sprint": {"status": "future"},
}

# --- fixed values: fields a general update may change -------------------------
PATCH_ALLOW: dict[str, tuple[str, ...]] = {
    "user": ("email", "first_name", "last_name", "phone"),
    "project": ("project_name", "description", "start_date", "end_date", "status", "owner_id"),
    "sprint": ("sprint_name", "goal", "start_date", "end_date", "status"),
    "issue": ("description", "issue_type", "priority", "due_date", "story_points", "parent_issue_id"),
    "worklog": ("hours_logged", "work_date", "description"),
    "comment": ("comment_text",),
}

# --- fixed values: text length limits (column -> (min, max)) ------------------
LENGTHS: dict[tuple[str, str], tuple[int | None, int | None]] = {
    ("user", "username"): (3, 255),
    ("user", "email"): (None, 255),
    ("user", "first_name"): (None, 100),
    ("user", "last_name"): (None, 100),
    ("user", "phone"): (None, 20),
    ("project", "project_name"): (1, 255),
    ("sprint", "sprint_name"): (1, 255),
    ("issue", "description"): (1, None),
    ("comment", "comment_text"): (1, None),
    ("attachment", "file_name"): (None, 255),
    ("attachment", "file_type"): (None, 100),
    ("attachment", "file_path"): (None, 512),
}

# Natural keys that must be unique under the case/accent-insensitive collation.
UNIQUE_KEYS: tuple[tuple[str, str], ...] = (
    ("user", "username"), ("user", "email"), ("project", "project_key"),
    ("attachment", "file_path"),
)


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    on_delete: str  # "cascade" | "set_null"

    @property
    def parent_key(self) -> str:
        return PRIMARY_KEYS[self.parent]


FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("project", "owner_id", "user", "set_null"),
    ForeignKey("sprint", "project_id", "project", "cascade"),
    ForeignKey("issue", "project_id", "project", "cascade"),
    ForeignKey("issue", "sprint_id", "sprint", "set_null"),
    ForeignKey("issue", "reporter_id", "user", "set_null"),
    ForeignKey("issue", "assignee_id", "user", "set_null"),
    ForeignKey("issue", "parent_issue_id", "issue", "set_null"),
    ForeignKey("comment", "issue_id", "issue", "cascade"),
    ForeignKey("comment", "user_id", "user", "set_null"),
    ForeignKey("attachment", "issue_id", "issue", "cascade"),
    ForeignKey("attachment", "user_id", "user", "set_null"),
    ForeignKey("worklog", "issue_id", "issue", "cascade"),
    ForeignKey("worklog", "user_id", "user", "set_null"),
)

# Parents before children: the order a cascade walks the key graph.
CASCADE_ORDER = ("user", "project", "sprint", "issue", "comment", "attachment", "worklog")

# Schemas of change inputs (the set form of the request models).
STATUS_CHANGE = "issue_id int, status string, change_id long"
ASSIGNEE_CHANGE = "issue_id int, assignee_id int, change_id long"
SPRINT_REQUEST = "request_id int, issue_id int, sprint_id int"
ACTIVITY = "event_id long, ts timestamp, user_id int, issue_id int, kind string, hours decimal(5,2)"

# --- fixed values: activity kinds and their effect on an issue ----------------
TOUCHING_KINDS = ("comment_insert", "comment_update", "worklog_insert", "attachment_insert")
NON_TOUCHING_KINDS = ("comment_delete", "worklog_update", "worklog_delete", "attachment_delete")
HOURS_SIGN = {"worklog_insert": 1, "worklog_delete": -1}


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]
