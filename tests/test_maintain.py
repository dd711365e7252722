"""Kept reports and checks equal a full recomputation after random changes."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from issuegrid.operators import maintain, quality, reports
from issuegrid.schema import PRIMARY_KEYS, SCHEMAS

T0 = dt.datetime(2025, 1, 1)
TABLES = ("user", "project", "sprint", "issue", "comment", "attachment", "worklog")


def _row(r, table, key, ids, dangling):
    """A row of ``table``; its keys come from ``ids`` or, with ``dangling``, also from outside."""
    def some(parent, null=True):
        pool = ids[parent] + ([99, 98] if dangling else []) + ([None] if null or not ids[parent] else [])
        return r.choice(pool)

    at = T0 + dt.timedelta(minutes=r.randrange(6))
    own = {"user": {"username": f"u{key}"}, "project": {"owner_id": some("user"), "project_key": f"P{key}"},
           "sprint": {"project_id": some("project", False)},
           "issue": {"project_id": some("project", False), "sprint_id": some("sprint"), "reporter_id": some("user"), "assignee_id": some("user"),
                     "parent_issue_id": some("issue"), "updated_date": r.choice([at, None])},
           "comment": {"issue_id": some("issue", False), "user_id": some("user"), "created_at": at, "updated_at": r.choice([None, at])},
           "attachment": {"issue_id": some("issue", False), "user_id": some("user"), "uploaded_at": at},
           "worklog": {"issue_id": some("issue", False), "user_id": some("user"), "hours_logged": Decimal(r.randrange(1, 900)) / 100, "created_at": at}}[table]
    return tuple(key if f.name == PRIMARY_KEYS[table] else own.get(f.name) for f in SCHEMAS[table].fields)


def _states(seed, dangling):
    """Two states of the tables: some rows stay, some change, come or go."""
    r = random.Random(seed)
    size = {"user": 4, "project": 3, "sprint": 4, "issue": 8, "comment": 14, "attachment": 8, "worklog": 20}
    states, rows = [], {t: {} for t in TABLES}
    for _ in range(2):
        ids = {t: r.sample(range(1, n + 3), n) for t, n in size.items()}
        now = {t: {} for t in TABLES}
        for t in TABLES:
            for k in ids[t]:
                keep = rows[t].get(k)
                names = SCHEMAS[t].names
                sound = keep is not None and all(
                    keep[names.index(c)] is None or keep[names.index(c)] in ids[p] for c, p in (
                        ("project_id", "project"), ("issue_id", "issue"), ("sprint_id", "sprint"), ("user_id", "user"), ("owner_id", "user"),
                        ("reporter_id", "user"), ("assignee_id", "user"), ("parent_issue_id", "issue")) if c in names)
                now[t][k] = keep if (sound or (dangling and keep)) and r.random() < 0.6 else _row(r, t, k, ids, dangling)
        states.append(now)
        rows = now
    return states


def _frames(spark, state):
    out = {}
    for t in TABLES:
        schema = SCHEMAS[t].__class__([f.__class__(f.name, f.dataType, True) for f in SCHEMAS[t].fields])
        out[t] = spark.createDataFrame(list(state[t].values()), schema)
    return out


def _same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_follow_changes(spark, seed):
    old, new = (_frames(spark, s) for s in _states(seed, dangling=False))
    delta = maintain.changes_between(old, new)
    _same(maintain.issue_hours(reports.issue_hours(old["issue"], old["worklog"]), delta), reports.issue_hours(new["issue"], new["worklog"]))
    state = maintain.user_project_hours_after(maintain.user_project_hours(old["issue"], old["worklog"]), old["issue"], new["worklog"], delta)
    _same(state, maintain.user_project_hours(new["issue"], new["worklog"]))
    _same(maintain.project_hours(state, new["project"]), reports.project_hours(new["project"], new["issue"], new["worklog"]))
    _same(maintain.hours_by_user(state, new["user"]), reports.hours_by_user(new["issue"], new["worklog"], new["user"]))
    _same(maintain.user_issue_counts(reports.user_issue_counts(old["user"], old["issue"]), delta), reports.user_issue_counts(new["user"], new["issue"]))
    counts = maintain.project_issue_counts(reports.project_issue_counts(old["project"], old["issue"]), delta)
    _same(counts, reports.project_issue_counts(new["project"], new["issue"]))
    children = ("issue", "comment", "worklog", "attachment")
    _same(maintain.issue_child_counts(reports.issue_child_counts(*[old[c] for c in children]), delta), reports.issue_child_counts(*[new[c] for c in children]))
    last = [reports.issue_last_activity(s["issue"], reports.touch_events(s["comment"], s["worklog"], s["attachment"])) for s in (old, new)]
    _same(maintain.issue_last_activity_after(last[0], new, delta), last[1])
    sprints = maintain.sprint_counts_after(maintain.sprint_counts(old["sprint"]), delta)
    _same(maintain.project_report(new["project"], maintain.project_hours(state, new["project"]), counts, sprints, maintain.hours_by_user(state, new["user"])),
          reports.project_report(new["project"], new["sprint"], new["issue"], new["worklog"], new["user"]))


@pytest.mark.parametrize("seed", [3, 4])
def test_checks_follow_changes_of_tables_with_dangling_keys(spark, seed):
    old, new = (_frames(spark, s) for s in _states(seed, dangling=True))
    delta = maintain.changes_between(old, new)
    _same(maintain.fk_violations(quality.fk_violations(old), new, delta), quality.fk_violations(new))
    _same(maintain.parent_project_mismatch(quality.parent_project_mismatch(old["issue"]), new["issue"], delta), quality.parent_project_mismatch(new["issue"]))
    _same(maintain.sprint_project_mismatch(quality.sprint_project_mismatch(old["issue"], old["sprint"]), new, delta),
          quality.sprint_project_mismatch(new["issue"], new["sprint"]))
    state = maintain.user_project_hours_after(maintain.user_project_hours(old["issue"], old["worklog"]), old["issue"], new["worklog"], delta)
    _same(state, maintain.user_project_hours(new["issue"], new["worklog"]))


def test_named_keys_bound_what_is_compared_and_nothing_changed_changes_nothing(spark):
    old, new = (_frames(spark, s)["worklog"] for s in _states(5, dangling=False))
    keys = old.select("worklog_id").unionByName(new.select("worklog_id"))
    _same(maintain.changed_rows(old, new, keys, "worklog_id"), maintain.changed_rows(old, new))
    assert maintain.changed_rows(old, old).isEmpty()
    stored = spark.createDataFrame([], "child_table string, fk_column string, child_id long, missing_key long")
    tables = _frames(spark, _states(5, dangling=False)[0])
    none = maintain.changes_between(tables, tables)
    assert maintain.fk_violations(stored, tables, none).isEmpty()


def test_only_tables_that_are_read_are_compared(spark):
    old, new = (_frames(spark, s) for s in _states(3, False))
    delta = maintain.changes_between(old, {**new, "worklog": None})     # a table that cannot be compared
    counts = maintain.project_issue_counts(reports.project_issue_counts(old["project"], old["issue"]), delta)
    _same(counts, reports.project_issue_counts(new["project"], new["issue"]))
    assert delta["issue"] is delta["issue"] and set(delta) == set(TABLES)


def test_changed_rows_are_dealt_out_before_they_are_grouped(spark):
    old, new = (_frames(spark, s) for s in _states(4, True))
    plan = maintain.changed_rows(old["issue"], new["issue"])._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" in plan and plan.index("Exchange") > plan.rindex("HashAggregate")     # no grouping below the exchange


def test_states_compared_in_the_columns_read_give_the_same_reports(spark):
    from issuegrid.plans import q_maintain as q

    old, new = (_frames(spark, s) for s in _states(6, dangling=False))
    def delta(columns):
        return maintain.changes_between(old, new, columns)

    counts = delta(q.USER_COUNTS)
    assert counts["issue"].columns == [*q.USER_COUNTS["issue"], maintain.SIGN] and set(counts) == set(q.USER_COUNTS)
    _same(maintain.user_issue_counts(reports.user_issue_counts(old["user"], old["issue"]), counts), reports.user_issue_counts(new["user"], new["issue"]))
    _same(maintain.project_issue_counts(reports.project_issue_counts(old["project"], old["issue"]), delta(q.PROJECT_COUNTS)),
          reports.project_issue_counts(new["project"], new["issue"]))
    hours = delta(q.HOURS)
    state = maintain.user_project_hours_after(maintain.user_project_hours(old["issue"], old["worklog"]), old["issue"], new["worklog"], hours)
    _same(state, maintain.user_project_hours(new["issue"], new["worklog"]))
    _same(maintain.issue_hours(reports.issue_hours(old["issue"], old["worklog"]), hours), reports.issue_hours(new["issue"], new["worklog"]))
    children, touches = ("issue", "comment", "worklog", "attachment"), delta(q.TOUCHES)
    _same(maintain.issue_child_counts(reports.issue_child_counts(*[old[c] for c in children]), touches), reports.issue_child_counts(*[new[c] for c in children]))
    last = [reports.issue_last_activity(s["issue"], reports.touch_events(s["comment"], s["worklog"], s["attachment"])) for s in (old, new)]
    _same(maintain.issue_last_activity_after(last[0], new, touches), last[1])


def test_checks_of_states_compared_in_their_keys(spark):
    from issuegrid.plans import q_maintain as q

    old, new = (_frames(spark, s) for s in _states(7, dangling=True))
    def delta(columns):
        return maintain.changes_between(old, new, columns)

    _same(maintain.fk_violations(quality.fk_violations(old), new, delta(q.KEYS)), quality.fk_violations(new))
    _same(maintain.parent_project_mismatch(quality.parent_project_mismatch(old["issue"]), new["issue"], delta(q.PARENTS)), quality.parent_project_mismatch(new["issue"]))
    _same(maintain.sprint_project_mismatch(quality.sprint_project_mismatch(old["issue"], old["sprint"]), new, delta(q.SPRINTS)),
          quality.sprint_project_mismatch(new["issue"], new["sprint"]))


def test_saved_rows_are_computed_once_and_keep_their_types(spark):
    seen = spark.sparkContext.accumulator(0)
    def count(rows):
        for row in rows:
            seen.add(1)
            yield row

    rows = _frames(spark, _states(8, True)[0])["worklog"]
    kept = maintain.saved(spark.createDataFrame(rows.rdd.mapPartitions(count), rows.schema))
    _same(kept, rows)
    assert seen.value == rows.count() and kept.schema == rows.schema
    assert maintain.saved(rows.where("false")).isEmpty()
    scan = kept.select("hours_logged")._jdf.queryExecution().executedPlan().toString()
    assert "hours_logged" in scan and "description" not in scan          # only the column asked for is read back


def test_new_state_and_changes_come_from_one_copy_of_both_states(spark, monkeypatch):
    old, new = (_frames(spark, s)["worklog"] for s in _states(9, dangling=True))
    new = new.unionByName(new.limit(3)).unionByName(new.limit(1))               # rows that come twice and three times
    new = new.unionByName(new.limit(2).selectExpr("CAST(NULL AS BIGINT) AS worklog_id", *new.columns[1:]))
    kept, written = maintain.saved, []
    monkeypatch.setattr(maintain, "saved", lambda df: written.append(df) or kept(df))
    columns = {"worklog": ("worklog_id", "issue_id", "user_id", "hours_logged")}
    for dealt_by in (None, {"worklog": "worklog_id"}):
        del written[:]
        now, delta = maintain.compared({"worklog": old}, {"worklog": new}, columns, dealt_by)
        assert set(now) == set(delta) == {"worklog"} and not written            # nothing before it is read
        o, n = (df.select(*columns["worklog"]) for df in (old, new))
        _same(now["worklog"], n)
        _same(delta["worklog"], maintain.changed_rows(o, n))
        assert len(written) == 1


def test_rows_dealt_out_by_key_are_not_dealt_out_again_to_be_compared(spark):
    old, new = (_frames(spark, s)["worklog"] for s in _states(10, dangling=False))
    gone = new.select("worklog_id").limit(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = old.select("worklog_id", "hours_logged")
        after = base.repartition("worklog_id").join(gone.hint("merge"), "worklog_id", "left_anti")
        plan = maintain.both_states(base, after, "worklog_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("Union") < plan.index("Exchange")                          # grouped where the union is


def test_worklogs_are_shuffled_once_for_the_hours_of_users(spark):
    state = _frames(spark, _states(11, dangling=False)[0])
    plan = maintain.user_project_hours(state["issue"], state["worklog"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Aggregate") < plan.index("Join")


def test_project_report_works_out_the_hours_of_users_once(spark, monkeypatch):
    from issuegrid.plans import q_maintain as q
    from issuegrid.sources.fixture import fixture_tables

    kept, written = maintain.saved, []
    monkeypatch.setattr(maintain, "saved", lambda df: written.append(set(df.columns)) or kept(df))
    q.maintained_project_report(fixture_tables(spark, "/root/testdata/sf0.001"))
    assert written.count({"project_id", "user_id", "hours", "logs"}) == 1
