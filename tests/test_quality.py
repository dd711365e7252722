from decimal import Decimal

from edge_rows import T0, base_tables, table

from issuegrid.operators import quality


def _reasons(df, table_name, key):
    return {r[key]: list(r.reasons) for r in quality.with_reasons(df, table_name).collect()}


def test_h5_hours_rules(spark):
    df = spark.createDataFrame(
        [(1, 1, Decimal("0"), T0.date()), (2, 1, Decimal("-1"), T0.date()), (3, 1, Decimal("0.004"), T0.date()),
         (4, 1, Decimal("1000.00"), T0.date()), (5, 1, Decimal("0.01"), T0.date())],
        "worklog_id int, issue_id int, hours_logged decimal(10,3), work_date date")
    got = _reasons(df, "worklog", "worklog_id")
    assert got[1] == ["hours_logged:not_positive"]
    assert got[2] == ["hours_logged:not_positive"]
    assert got[3] == ["hours_logged:rounds_to_zero"]
    assert got[4] == ["hours_logged:too_large"]
    assert got[5] == []


def test_h6_project_key_pattern(spark):
    keys = ["DEMO", "demo", "A-B", "", "ABCDEFGHIJK", "AB\n"]
    df = spark.createDataFrame([(i, k, "n", "planning") for i, k in enumerate(keys)],
                               "project_id int, project_key string, project_name string, status string")
    got = _reasons(df, "project", "project_id")
    assert got[0] == []
    for i in range(1, 6):
        assert "project_key:bad_pattern" in got[i], keys[i]


def test_h7_duplicates_insensitive_no_trim(spark):
    names = ["bob", "BOB", "böb", "bob "]
    users = spark.createDataFrame([(i, n, f"{i}@x.org") for i, n in enumerate(names, 1)],
                                  "user_id int, username string, email string")
    dups = quality.duplicate_keys({"user": users}).collect()
    assert sorted((r.row_id, r.kept_id) for r in dups if r.column_name == "username") == [(2, 1), (3, 1)]


def test_h8_sprint_in_other_project(spark):
    t = base_tables(spark)
    proposed = spark.createDataFrame([(1, 4, 1), (2, 4, 2), (3, 1, None), (4, 1, 77)],
                                     "request_id int, issue_id int, sprint_id int")
    got = quality.sprint_project_mismatch(t["issue"], t["sprint"], proposed).collect()
    assert [(r.request_id, r.issue_project_id, r.sprint_project_id) for r in got] == [(1, 200, 100)]


def test_h9_parent_in_other_project(spark):
    t = base_tables(spark)
    moved = t["issue"].withColumn("parent_issue_id", t["issue"].parent_issue_id)
    extra = table(spark, "issue", [dict(issue_id=5, project_id=200, description="five", issue_type="Task",
                                        priority="Low", status="To Do", parent_issue_id=1)])
    got = quality.parent_project_mismatch(moved.unionByName(extra)).collect()
    assert [(r.issue_id, r.parent_issue_id) for r in got] == [(5, 1)]


def test_fk_violations_and_split_is_partition(spark):
    t = base_tables(spark)
    bad_worklog = table(spark, "worklog", [dict(worklog_id=9, issue_id=99, user_id=77,
                                                hours_logged=Decimal("1.00"), work_date=T0.date())])
    t2 = dict(t, worklog=t["worklog"].unionByName(bad_worklog))
    got = sorted((r.child_table, r.fk_column, r.child_id, r.missing_key) for r in quality.fk_violations(t2).collect())
    assert got == [("worklog", "issue_id", 9, 99), ("worklog", "user_id", 9, 77)]
    ok, bad = quality.validate(t2["issue"], "issue")
    assert ok.count() + bad.count() == t2["issue"].count()


def test_violation_counts(spark):
    t = base_tables(spark)
    bad = table(spark, "issue", [
        dict(issue_id=8, project_id=100, description="", issue_type="Chore", priority="Low", status="To Do",
             story_points=-1),
        dict(issue_id=9, project_id=200, sprint_id=1, description="d", issue_type="Task", priority="Low",
             status="To Do", reporter_id=77, parent_issue_id=1),
        dict(issue_id=10, project_id=100, sprint_id=5, description="d", issue_type="Task", priority="Low",
             status="To Do", parent_issue_id=55)])
    dup_user = table(spark, "user", [dict(user_id=13, username="ANN", email="x@y.org", password_hash="h",
                                          role="user")])
    t2 = dict(t, issue=t["issue"].unionByName(bad), user=t["user"].unionByName(dup_user))
    got = {(r.table_name, r.reason): r.violations for r in quality.violation_counts(t2).collect()}
    assert got == {("issue", "issue_type:not_allowed"): 1, ("issue", "description:too_short"): 1,
                   ("issue", "story_points:negative"): 1, ("issue", "reporter_id:unknown_parent"): 1,
                   ("issue", "sprint_id:other_project"): 1, ("issue", "parent_issue_id:other_project"): 2,
                   ("issue", "sprint_id:unknown_parent"): 1, ("issue", "parent_issue_id:unknown_parent"): 1,
                   ("user", "username:duplicate"): 1}


def test_v14_project_missing(spark):
    t = base_tables(spark)
    new = spark.createDataFrame([(1, 100), (2, 999)], "request_id int, project_id int")
    assert [r.request_id for r in quality.project_missing(new, t["project"], "request_id").collect()] == [2]
