import pytest

from edge_rows import base_tables

from issuegrid.operators import access, lookup


def test_h23_assignee_may_write_but_not_read(spark):
    t = base_tables(spark)
    read = {(r.user_id, r.issue_id) for r in access.can_read_issue(t["project"], t["issue"]).collect()}
    write = {(r.user_id, r.issue_id) for r in access.can_write_issue(t["project"], t["issue"]).collect()}
    assert (11, 1) in write and (11, 1) not in read
    assert (10, 1) in read and (10, 4) in write and (10, 4) not in read


def test_admin_flag_and_filters(spark):
    t = base_tables(spark)
    assert [r.user_id for r in access.admin_users(t["user"]).collect()] == [12]
    assert access.visible_issues(t["issue"], t["project"], t["user"], 12).count() == 4
    assert sorted(r.issue_id for r in access.visible_issues(t["issue"], t["project"], t["user"], 11).collect()) == [4]
    assert access.visible_users(t["user"], 12).count() == 3
    assert access.visible_projects(t["project"]).count() == t["project"].count()
    only_self = access.visible_users(t["user"], 10).collect()
    assert [r.user_id for r in only_self] == [10] and "password_hash" not in only_self[0].asDict()


def test_delete_and_edit_entries(spark):
    t = base_tables(spark)
    dele = {(r.user_id, r.entry_kind, r.entry_id) for r in
            access.can_delete_entry(t["project"], t["issue"], t["comment"], t["worklog"], t["attachment"]).collect()}
    assert (11, "comment", 2) in dele               # owner of project 200 deletes an anonymous comment
    assert (10, "worklog", 2) in dele and (11, "worklog", 2) in dele
    edit = {(r.user_id, r.entry_kind, r.entry_id) for r in access.can_edit_entry(t["comment"], t["worklog"]).collect()}
    assert (10, "worklog", 2) not in edit and (11, "worklog", 2) in edit


def test_assignable_users_no_repeats(spark):
    t = base_tables(spark)
    visits = spark.createDataFrame([(10, 100), (11, 100), (12, 300)], "viewer_id int, project_id int")
    got = sorted(tuple(r) for r in access.assignable_users(visits, t["project"]).collect())
    assert got == [(10, 100, 10), (11, 100, 10), (11, 100, 11), (12, 300, 12)]


def test_h24_issue_filter(spark):
    t = base_tables(spark)
    assert {r.issue_id for r in lookup.issue_filter(t["issue"], project_id=100, sprint_id=2).collect()} == {4}
    assert lookup.issue_filter(t["issue"], project_id=200, sprint_id=0).count() == 1
    with pytest.raises(ValueError):
        lookup.issue_filter(t["issue"])


def test_lookups_and_public_columns(spark):
    t = base_tables(spark)
    keys = spark.createDataFrame([("BOB",), ("bob",), ("nobody",)], "key string")
    got = lookup.lookup_by_natural_key(t["user"], keys, "username").collect()
    assert [r.user_id for r in got] == [11]
    assert "password_hash" not in lookup.public_user_columns(t["user"]).columns
    by_key = lookup.lookup_by_keys(t["issue"], spark.createDataFrame([(1,), (1,), (3,)], "k int"), "issue_id")
    assert sorted(r.issue_id for r in by_key.collect()) == [1, 3]
    assert [r.issue_id for r in lookup.backlog(t["issue"]).collect()] == [2, 3]
    chk = {r.issue_id: r for r in lookup.exists_checks(t["issue"], t["project"], t["sprint"]).collect()}
    assert all(r.project_exists and r.sprint_in_project and r.parent_in_project for r in chk.values())
