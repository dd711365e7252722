"""Mixed change logs against a replay that takes the changes one by one."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from edge_rows import T0, base_tables, table
from pyspark.sql import Window
from pyspark.sql import functions as F

from issuegrid.operators import changelog
from issuegrid.plans import q_changes
from issuegrid.schema import AUTO_UPDATE_COLUMNS, FOREIGN_KEYS, ISSUE_STATUSES, ISSUE_TYPES, PATCH_ALLOW, PRIMARY_KEYS, PRIORITIES, SPRINT_STATUSES

@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


LOG = ("change_id long, ts timestamp, table_name string, action string, pk long, set_fields array<string>, project_id int, sprint_id int, parent_issue_id int, "
       "issue_id int, user_id int, reporter_id int, assignee_id int, owner_id int, description string, issue_type string, priority string, status string, "
       "story_points int, sprint_name string, goal string, comment_text string, hours_logged decimal(20,6), work_date date, project_name string")
FIELDS = [x.split()[0] for x in LOG.split(", ")]


def log_of(spark, changes):
    return spark.createDataFrame([tuple(c.get(f) for f in FIELDS) for c in changes], LOG)


def broken(table_name, row, fields):
    """Row rules of the values in ``fields`` (in the order of the checks)."""
    out, v = [], row.get
    missing = {"sprint": ["project_id", "sprint_name", "status"], "issue": ["project_id", "description", "issue_type", "priority", "status"], "project": ["project_name", "status"],
               "comment": ["issue_id", "comment_text"], "worklog": ["issue_id", "hours_logged", "work_date"]}[table_name]
    out += [f"{c}:missing" for c in missing if c in fields and v(c) is None]
    enums = {"sprint": [("status", SPRINT_STATUSES)], "issue": [("issue_type", ISSUE_TYPES), ("priority", PRIORITIES), ("status", ISSUE_STATUSES)],
             "project": [("status", ("planning", "active", "completed", "archived"))]}.get(table_name, [])
    out += [f"{c}:not_allowed" for c, values in enums if c in fields and v(c) is not None and v(c) not in values]
    for c in ("sprint_name", "project_name", "comment_text", "description"):
        if c in fields and v(c) == "" and not (c == "description" and table_name != "issue"):
            out.append(f"{c}:too_short")
    if table_name == "worklog" and "hours_logged" in fields and v("hours_logged") is not None:
        h = v("hours_logged")
        out += ["hours_logged:not_positive"] * (h <= 0) + ["hours_logged:too_large"] * (h > Decimal("999.99"))
    if table_name == "issue" and "story_points" in fields and (v("story_points") or 0) < 0:
        out.append("story_points:negative")
    return out


def replay(tables, changes):
    state = {t: {r[PRIMARY_KEYS[t]]: r.asDict() for r in df.collect()} for t, df in tables.items()}
    named, refused = {t: set(rows) for t, rows in state.items()}, {}

    def references(t, row, fields, same):
        out = []
        for fk in FOREIGN_KEYS:
            if fk.child == t and fk.column in fields and row.get(fk.column) is not None:
                parent = state[fk.parent].get(row[fk.column])
                if parent is None:
                    out.append(f"{fk.column}:unknown_parent")
                elif fk.column in same and row["project_id"] is not None and parent["project_id"] != row["project_id"]:
                    out.append(f"{fk.column}:other_project")
        return out

    def delete(t, key):
        del state[t][key]
        for fk in FOREIGN_KEYS:
            if fk.parent == t:
                for k in [k for k, r in state[fk.child].items() if r[fk.column] == key]:
                    if fk.on_delete == "cascade":
                        if k in state[fk.child]:
                            delete(fk.child, k)
                    else:
                        state[fk.child][k][fk.column] = None

    def touch(issue, ts):
        state["issue"][issue]["updated_date"] = ts

    for c in sorted(changes, key=lambda c: c["change_id"]):
        t, action, pk = c["table_name"], c["action"], c.get("pk")
        reasons = []
        if action == "insert" and t in changelog.INSERTS:
            row = dict.fromkeys(tables[t].columns)
            row |= {k: c.get(k) for k in row if k in FIELDS}
            row[PRIMARY_KEYS[t]] = pk
            if t == "issue":
                row |= {"status": "To Do", "issue_type": row["issue_type"] or "Task", "priority": row["priority"] or "Medium"}
            if t == "sprint":
                row["status"] = row["status"] or "future"
            row["created_date" if t == "issue" else "created_at"] = c["ts"]
            reasons = broken(t, row, set(row) - {PRIMARY_KEYS[t]})
            if pk is None or pk in named[t]:
                reasons.append(f"{PRIMARY_KEYS[t]}:taken")
            named[t].add(pk)
            found = references(t, row, set(row), {"sprint_id", "parent_issue_id"} if t == "issue" else set())
            # The parent issue is looked at last, and only of rows that are right so far.
            reasons += [f for f in found if not f.startswith("parent_issue_id")]
            reasons += [f for f in found if f.startswith("parent_issue_id")]
            if not reasons:
                if t == "worklog":
                    row["hours_logged"] = row["hours_logged"].quantize(Decimal("0.01"))
                state[t][pk] = row
                if t in ("comment", "worklog"):
                    touch(row["issue_id"], c["ts"])
        elif action == "delete" and t in PRIMARY_KEYS:
            if pk in state[t]:
                delete(t, pk)
            else:
                reasons = [f"{PRIMARY_KEYS[t]}:not_found"]
        elif (action == "patch" and t in changelog.PATCHES) or (t == "issue" and action in changelog.ISSUE_ACTIONS):
            fields = [changelog.ISSUE_ACTIONS[action]] if action != "patch" else [f for f in c.get("set_fields") or [] if f in PATCH_ALLOW[t] and f in FIELDS]
            if pk not in state[t]:
                reasons = [f"{PRIMARY_KEYS[t]}:not_found"]
            else:
                old = state[t][pk]
                new = {f: c.get(f) for f in fields}
                reasons = broken(t, new, set(fields)) + references(t, {**new, "project_id": old.get("project_id")}, fields, {"sprint_id"})
                if not reasons:
                    if new.get("hours_logged") is not None:
                        new["hours_logged"] = new["hours_logged"].quantize(Decimal("0.01"))
                    text = old.get("comment_text")
                    changed = any(old[f] != new[f] for f in fields)
                    old |= new
                    if t in AUTO_UPDATE_COLUMNS and (changed or action in changelog.ALWAYS_TOUCHES):
                        old[AUTO_UPDATE_COLUMNS[t]] = c["ts"]
                    if t == "comment" and changed and text.lower() != new["comment_text"].lower():
                        touch(old["issue_id"], c["ts"])
        else:
            reasons = ["action:not_supported"]
        if reasons:
            refused[c["change_id"]] = reasons
    return state, refused


def check(spark, changes, tables=None):
    tables = tables or base_tables(spark)
    new, refused = changelog.apply_log(tables, log_of(spark, changes))
    state, reasons = replay(tables, changes)
    assert {r.change_id: sorted(r.reasons) for r in refused.collect()} == {k: sorted(v) for k, v in reasons.items()}
    for t, df in new.items():
        assert {r[PRIMARY_KEYS[t]]: r.asDict() for r in df.collect()} == state[t], t


def at(k):
    return T0 + dt.timedelta(hours=k)


def random_log(seed, n):
    r, out = random.Random(seed), []
    new = {"sprint": [50], "issue": [1000], "comment": [2000], "worklog": [3000]}
    old = {"user": [10, 11, 12], "project": [100, 200, 300], "sprint": [1, 2], "issue": [1, 2, 3, 4], "comment": [1, 2], "worklog": [1, 2, 3, 4, 5], "attachment": [1]}

    def key(t):
        return r.choice(old[t] + new.get(t, [])[-6:] + [77])

    for k in range(1, n + 1):
        c = dict(change_id=k, ts=at(k))
        what = r.random()
        if what < 0.35:
            t = r.choice(["sprint", "issue", "issue", "issue", "comment", "worklog"])
            new[t].append(new[t][-1] + 1)
            pk = new[t][-1] if r.random() < 0.95 else r.choice([key(t), None])
            c |= dict(table_name=t, action="insert", pk=pk, project_id=r.choice([100, 100, 100, 200, 300, None]), sprint_id=r.choice([None, None, key("sprint")]),
                      parent_issue_id=r.choice([None, key("issue"), new["issue"][-2:][0]]), issue_id=key("issue"), user_id=r.choice([None, key("user")]),
                      reporter_id=r.choice([None, key("user")]), assignee_id=r.choice([None, key("user")]), description=r.choice(["x", "y", "z", ""]), sprint_name=r.choice(["s", "t", ""]),
                      comment_text=r.choice(["new", "text", None]), hours_logged=r.choice([Decimal("1.5"), Decimal("2.255"), Decimal("0"), Decimal("1000")]), work_date=dt.date(2025, 2, 1),
                      story_points=r.choice([None, 1, -1]), issue_type=r.choice([None, "Bug", "Wish"]) if r.random() < 0.3 else None)
        elif what < 0.47:
            t = r.choice(["user", "project", "sprint", "issue", "issue", "comment", "worklog", "attachment"])
            if t in ("user", "project") and r.random() < 0.7:
                t = "issue"
            c |= dict(table_name=t, action="delete", pk=key(t))
        elif what < 0.75:
            t = r.choice(["project", "sprint", "issue", "issue", "comment", "worklog"])
            c |= dict(table_name=t, action="patch", pk=key(t), set_fields=r.choice([["description", "status"], ["story_points", "priority"], ["parent_issue_id"], ["owner_id", "project_name"],
                      ["goal"], ["comment_text"], ["hours_logged"], ["sprint_name", "status"], [], None]), description=r.choice(["x", "two", "", None]), status=r.choice(["active", "future", "odd"]),
                      story_points=r.choice([3, None, -2]), priority=r.choice(["High", "Low", "Odd"]), parent_issue_id=r.choice([None, key("issue")]), owner_id=r.choice([None, key("user")]),
                      project_name=r.choice(["A", "B", ""]), goal=r.choice([None, "g"]), comment_text=r.choice(["x", "X", "hello", "HELLO", ""]), hours_logged=r.choice([Decimal("2.5"), Decimal("0"), Decimal("4.125")]),
                      sprint_name=r.choice(["S1", "S2"]))
        elif what < 0.98:
            c |= dict(table_name="issue", action=r.choice(["status", "assign", "sprint"]), pk=key("issue"), status=r.choice([*ISSUE_STATUSES, "Odd", None]), assignee_id=r.choice([None, key("user")]),
                      sprint_id=r.choice([None, key("sprint")]))
        else:
            c |= dict(table_name=r.choice(["user", "none", None]), action=r.choice(["insert", "merge", None]), pk=1)
        out.append(c)
    return out


def test_random_log_matches_a_replay(spark, monkeypatch):
    monkeypatch.setattr(changelog, "BLOCK", 16)           # setters of a field lie in many blocks
    check(spark, random_log(2, 400))


def test_parents_before_children_in_time(spark):
    """A comment on an issue deleted earlier is refused; a chain of inserts falls with its first."""
    insert = dict(table_name="issue", action="insert", project_id=100, description="d")
    changes = [dict(change_id=1, ts=at(1), table_name="issue", action="delete", pk=1), dict(change_id=2, ts=at(2), table_name="comment", action="insert", pk=9, issue_id=1, comment_text="late"),
               dict(change_id=3, ts=at(3), pk=500, **insert), dict(change_id=4, ts=at(4), table_name="comment", action="insert", pk=10, issue_id=500, comment_text="in time"),
               *(dict(change_id=k, ts=at(k), pk=600 + k, parent_issue_id=600 + k - 1 if k > 10 else 1, **insert) for k in range(10, 60)),
               *(dict(change_id=k, ts=at(k), pk=600 + k, parent_issue_id=600 + k - 1 if k > 70 else 500, **insert) for k in range(70, 120)),
               dict(change_id=200, ts=at(200), table_name="project", action="delete", pk=100), dict(change_id=201, ts=at(201), pk=999, **insert)]
    check(spark, changes)


def test_empty_log_and_empty_tables(spark):
    check(spark, [])
    empty = {t: table(spark, t, []) for t in PRIMARY_KEYS}
    check(spark, [dict(change_id=1, ts=at(1), table_name="issue", action="insert", pk=1, project_id=1, description="d")], empty)


def test_log_reads_the_numbered_worklogs_from_one_copy(spark, monkeypatch):
    t = dict(base_tables(spark))
    t["worklog"] = t["worklog"].withColumn("worklog_id", F.row_number().over(Window.partitionBy("issue_id").orderBy("worklog_id")).cast("long"))
    t["change_log"] = spark.createDataFrame([], "table_name string, status string")
    monkeypatch.setattr(q_changes.changelog, "apply_log", lambda tables, log: (tables, log))
    worklog = q_changes._logged(t)[0]["worklog"]
    assert "Window" not in worklog._jdf.queryExecution().sparkPlan().toString()
    assert worklog.count() == t["worklog"].count()
