import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from edge_rows import T0, as_dict, base_tables

from issuegrid.operators import changes, claims, reports
from issuegrid.operators.lookup import insensitive

NOW = dt.datetime(2025, 6, 1, 12, 0, 0)
NOW_S = "2025-06-01 12:00:00"


def test_h17_patch_null_present_vs_absent_and_allow_list(spark):
    t = base_tables(spark)
    issue = t["issue"].withColumn("due_date", F.lit(dt.date(2025, 2, 1)))
    patches = spark.createDataFrame(
        [(1, 1, ["due_date", "status"], None, "Done", None)],
        "change_id long, pk int, set_fields array<string>, due_date date, status string, priority string")
    new, rejected = changes.apply_patches("issue", issue, patches, NOW_S)
    got = as_dict(new, "issue_id")
    assert got[1].due_date is None and got[1].status == "To Do" and got[1].priority == "High"
    assert got[1].updated_date == NOW and got[2].updated_date == T0
    assert rejected.count() == 0


def test_patch_order_and_rejection(spark):
    t = base_tables(spark)
    patches = spark.createDataFrame(
        [(1, 2, ["priority"], "Lowest"), (2, 2, ["priority"], "Urgent"), (3, 3, ["priority"], "Medium")],
        "change_id long, pk int, set_fields array<string>, priority string")
    new, rejected = changes.apply_patches("issue", t["issue"], patches, NOW_S)
    got = as_dict(new, "issue_id")
    assert got[2].priority == "Lowest" and got[2].updated_date == NOW
    assert got[3].priority == "Medium" and got[3].updated_date == T0      # same value: not touched
    assert [r.change_id for r in rejected.collect()] == [2]


def test_h18_insert_project_forced_values(spark):
    t = base_tables(spark)
    req = spark.createDataFrame(
        [(1, "NEW", "New one", "active", dt.date(2025, 1, 1), 12)],
        "request_id long, project_key string, project_name string, status string, start_date date, acting int")
    ok, bad = changes.insert_rows("project", req, t, NOW_S, acting_user="acting")
    row = ok.first()
    assert row.status == "planning" and row.start_date is None and row.owner_id == 12
    assert row.project_id == 301 and row.created_at == NOW and bad.count() == 0


def test_insert_rejects_unknown_parent_and_bad_hours(spark):
    t = base_tables(spark)
    req = spark.createDataFrame(
        [(1, 1, 10, Decimal("1.00")), (2, 99, 10, Decimal("1.00")), (3, 1, 10, Decimal("0.00")),
         (4, 2, None, Decimal("2.00"))],
        "request_id long, issue_id int, user_id int, hours_logged decimal(5,2)")
    req = req.withColumn("work_date", F.lit(dt.date(2025, 1, 9)))
    ok, bad = changes.insert_rows("worklog", req, t, NOW_S, acting_user="user_id")
    assert sorted((r.request_id, r.worklog_id) for r in ok.collect()) == [(1, 6), (4, 7)]
    assert {r.request_id: list(r.reasons) for r in bad.collect()} == {
        2: ["issue_id:unknown_parent"], 3: ["hours_logged:not_positive"]}


def test_assign_ids_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.rand(1).alias("v")).repartition(13)
    got = changes.assign_ids(df, "new_id", ["k"], 1000)
    expect = df.withColumn("e", F.row_number().over(Window.orderBy("k")) + 1000)
    joined = got.join(expect, "k")
    assert joined.filter(F.col("new_id") != F.col("e")).count() == 0
    assert got.count() == 5000 and got.select(F.min("new_id"), F.max("new_id")).first() == (1001, 6000)


def test_h19_sprint_requests(spark):
    t = base_tables(spark)
    req = spark.createDataFrame([(1, 999, 1), (2, 1, None), (3, 4, 1), (4, 2, 1)],
                                "request_id int, issue_id int, sprint_id int")
    new, out = changes.apply_sprint_requests(t["issue"], t["sprint"], req, NOW_S)
    o = {r.request_id: (r.outcome, r.reason) for r in out.collect()}
    assert o[1] == ("rejected", "Issue not found")
    assert o[2] == ("unassigned", None)
    assert o[3] == ("rejected", changes.SPRINT_REJECTED)
    assert o[4] == ("assigned", None)
    got = as_dict(new, "issue_id")
    assert got[1].sprint_id is None and got[2].sprint_id == 1 and got[4].sprint_id == 2
    assert got[1].updated_date == NOW and got[4].updated_date == T0


def test_status_and_assignment_batches(spark):
    t = base_tables(spark)
    st = spark.createDataFrame([(1, 1, "Done"), (2, 1, "Archived"), (3, 3, "Blocked")],
                               "change_id long, issue_id int, status string")
    new, rej = changes.apply_status_changes(t["issue"], st, NOW_S)
    got = as_dict(new, "issue_id")
    assert got[1].status == "Done" and got[3].status == "Blocked" and got[3].updated_date == NOW
    assert [r.change_id for r in rej.collect()] == [2]
    asg = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (3, 2, 77), (4, 3, None)],
                                "change_id long, issue_id int, assignee_id int")
    new, rej = changes.apply_assignments(t["issue"], t["user"], asg, NOW_S)
    got = as_dict(new, "issue_id")
    assert got[1].assignee_id == 11 and got[1].updated_date == NOW          # 11 -> 10 -> 11 moved
    assert got[3].assignee_id is None and got[3].updated_date == T0         # null -> null: unchanged
    assert [r.change_id for r in rej.collect()] == [3]


def test_h20_delete_project_cascade(spark):
    t = base_tables(spark)
    keys = spark.createDataFrame([(100,)], "pk int")
    new, report = changes.delete_cascade(t, "project", keys)
    assert sorted(r.issue_id for r in new["issue"].collect()) == [4]
    assert sorted(r.worklog_id for r in new["worklog"].collect()) == [5]
    rep = {(r.table_name, r.action): r.row_count for r in report.collect()}
    assert rep[("issue", "deleted")] == 3 and rep[("worklog", "deleted")] == 4 and rep[("sprint", "deleted")] == 1


def test_h21_delete_user_set_null(spark):
    t = base_tables(spark)
    new, report = changes.delete_cascade(t, "user", spark.createDataFrame([(11,)], "pk int"))
    w = as_dict(new["worklog"], "worklog_id")
    assert w[2].user_id is None and w[5].user_id is None and w[5].hours_logged == Decimal("999.99")
    a3 = reports.hours_by_user(new["issue"], new["worklog"], new["user"]).collect()
    assert all(r.user_id != 11 for r in a3)
    before = as_dict(reports.project_hours(t["project"], t["issue"], t["worklog"]), "project_id")
    after = as_dict(reports.project_hours(new["project"], new["issue"], new["worklog"]), "project_id")
    assert {k: r.total_hours for k, r in before.items()} == {k: r.total_hours for k, r in after.items()}
    assert as_dict(new["issue"], "issue_id")[1].updated_date == T0       # set-null does not touch
    rep = {(r.table_name, r.action): r.row_count for r in report.collect()}
    assert rep[("project", "set_null:owner_id")] == 1 and rep[("worklog", "set_null:user_id")] == 2


def test_delete_nothing_changes_nothing(spark):
    t = base_tables(spark)
    new, report = changes.delete_cascade(t, "project", spark.createDataFrame([], "pk int"))
    assert report.count() == 0
    for name, df in t.items():
        assert new[name].exceptAll(df).count() == 0 and df.exceptAll(new[name]).count() == 0


def test_h22_case_only_comment_edit_does_not_touch(spark):
    t = base_tables(spark)
    edited = t["comment"].withColumn("comment_text", F.when(F.col("comment_id") == 1, F.lit("X"))
                                     .otherwise(F.lit("hello world")))
    events = changes.comment_edit_events(t["comment"], edited, NOW_S)
    assert [(r.issue_id, r.kind) for r in events.collect()] == [(4, "comment_update")]
    touched = as_dict(changes.issue_touch(t["issue"], events), "issue_id")
    assert touched[4].updated_date == NOW and touched[1].updated_date == T0


def test_reject_duplicates_against_old_and_batch(spark):
    t = base_tables(spark)
    new = spark.createDataFrame([(1, "ANN", "n1@x.org"), (2, "zoe", "z@x.org"), (3, "ZOE", "z2@x.org"),
                                 (4, "kim", "BOB@x.org")], "request_id long, username string, email string")
    got = {r.request_id: list(r.reasons) for r in changes.reject_duplicates("user", t["user"], new).collect()}
    assert got == {1: ["username:duplicate"], 2: [], 3: ["username:duplicate"], 4: ["email:duplicate"]}


def test_d8_auto_touch_only_on_real_change(spark):
    t = base_tables(spark)
    new = t["issue"].withColumn("priority", F.when(F.col("issue_id") == 2, F.lit("Highest")).otherwise(F.col("priority")))
    got = as_dict(changes.auto_touch(t["issue"], new, "issue", NOW_S), "issue_id")
    assert got[2].updated_date == NOW and got[1].updated_date == T0 and got[2].priority == "Highest"


def test_insert_user_forced_role_and_duplicates(spark):
    t = base_tables(spark)
    req = spark.createDataFrame(
        [(1, "zed", "zed@x.org", "hash", "admin"), (2, "ANN", "a2@x.org", "hash", "user"),
         (3, "no", "no@x.org", "hash", "user")],
        "request_id long, username string, email string, password_hash string, role string")
    dup = changes.reject_duplicates("user", t["user"], req).filter("accepted").select("request_id")
    ok, bad = changes.insert_rows("user", req.join(dup, "request_id", "left_semi"), t, NOW_S)
    assert [(r.user_id, r.username, r.role) for r in ok.collect()] == [(13, "zed", "user")]
    assert {r.request_id: list(r.reasons) for r in bad.collect()} == {3: ["username:too_short"]}


def test_patch_rejects_taken_unique_values(spark):
    t = base_tables(spark)
    patches = spark.createDataFrame(
        [(1, 10, ["email"], "BOB@x.org"),        # held by user 11
         (2, 11, ["email"], "Bob@X.org"),        # own email, other case: fine
         (3, 12, ["email"], "new@x.org"),        # first claim wins
         (4, 10, ["email"], "NEW@x.org")],       # claimed by an earlier patch
        "change_id long, pk int, set_fields array<string>, email string")
    new, rejected = changes.apply_patches("user", t["user"], patches, NOW_S)
    assert {r.change_id: list(r.reasons) for r in rejected.collect()} == {
        1: ["email:duplicate"], 4: ["email:duplicate"]}
    got = as_dict(new, "user_id")
    assert got[10].email == "ann@x.org" and got[11].email == "Bob@X.org" and got[12].email == "new@x.org"


def test_insert_rows_applies_unique_keys(spark):
    t = base_tables(spark)
    req = spark.createDataFrame(
        [(1, "ANN", "a2@x.org", "h"), (2, "nu", "n@x.org", "h"), (3, "newbie", "N@X.org", "h"),
         (4, "newbie", "z@x.org", "h")],
        "request_id long, username string, email string, password_hash string")
    ok, bad = changes.insert_rows("user", req, t, NOW_S)
    assert [(r.request_id, r.user_id) for r in ok.collect()] == [(3, 13)]
    assert {r.request_id: list(r.reasons) for r in bad.collect()} == {
        1: ["username:duplicate"], 2: ["username:too_short"], 4: ["username:duplicate"]}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_assign_ids_large_batch_is_dense_and_ordered(spark, adaptive):
    """A million rows with a wide column over 16 range partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("w"), 64).alias("wide"))
        got = changes.assign_ids(df, "new_id", ["k"], 10)
        stats = got.agg(F.countDistinct("new_id").alias("n"), F.min("new_id").alias("lo"), F.max("new_id").alias("hi")).first()
        assert (stats.n, stats.lo, stats.hi) == (1_000_000, 11, 1_000_010)
        assert got.join(got.select((F.col("new_id") - 1).alias("new_id"), F.col("k").alias("next")), "new_id").filter("next <= k").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_refused_request_holds_no_key(spark):
    users = spark.createDataFrame([(1, "ann", "ann@x.org")], "user_id int, username string, email string")
    rows = [(1, "bob", "ANN@x.org"), (2, "Bob", "b@x.org"), (3, "bob", "c@x.org"), (4, "carl", "b@X.org"), (5, "Carl", "d@x.org")]
    got = changes.reject_duplicates("user", users, spark.createDataFrame(rows, "request_id int, username string, email string")).collect()
    assert {r.request_id: list(r.reasons) for r in got} == {
        1: ["email:duplicate"], 2: [], 3: ["username:duplicate"], 4: ["email:duplicate"], 5: []}


def test_long_chain_of_refusals_is_exact(spark):
    users = spark.createDataFrame([], "user_id int, username string, email string")
    rows = [(k, f"n{k // 2}", f"m{(k + 1) // 2}") for k in range(1000)]
    new = spark.createDataFrame(rows, "request_id int, username string, email string")
    got = changes.reject_duplicates("user", users, new)
    assert [r.request_id for r in got.filter("accepted").orderBy("request_id").collect()] == list(range(0, 1000, 2))


def test_plain_and_other_characters_share_their_keys(spark):
    users = spark.createDataFrame([(1, "josé", "a@x.org"), (2, "plain", "b@x.org"), (3, "PLAIN", "b@x.org")], "user_id int, username string, email string")
    rows = [(1, "Jose", "n1@x.org"), (2, "PLÄIN", "n2@x.org"), (3, "zoë", "n3@x.org"), (4, "ZOE", "n4@x.org"), (5, "ｗide", "n5@x.org"),
            (6, "Wide", "n6@x.org"), (7, "a b", "n7@x.org"), (8, "ab", "n8@x.org"), (9, "a\u00adb", "n9@x.org"), (10, "ab\n", "N8@x.org")]
    got = {r.request_id: list(r.reasons) for r in changes.reject_duplicates(
        "user", users, spark.createDataFrame(rows, "request_id int, username string, email string")).collect()}
    refused = {k for k, v in got.items() if v}
    names, want = ["josé", "plain"], set()
    for k, name, _ in rows[:-1]:
        same = spark.createDataFrame([(n, name) for n in names], "a string, b string").select(insensitive("a") == insensitive("b")).collect()
        want |= {k} if any(r[0] for r in same) else set()
        names += [name] if k not in want else []
    assert refused == want | {10} and {1, 2, 4, 6} <= refused and 7 not in refused


def test_plain_characters_differ_but_for_case(spark):
    """What :mod:`.claims` takes for granted of the collation."""
    chars = spark.range(32, 127).select(F.expr("char(id)").alias("c"))
    pairs = chars.crossJoin(chars.withColumnRenamed("c", "d")).withColumns({"c": F.concat(F.lit("x"), "c", F.lit("y")), "d": F.concat(F.lit("x"), "d", F.lit("y"))})
    assert pairs.filter((insensitive("c") == insensitive("d")) != (F.lower("c") == F.lower("d"))).isEmpty()


def test_plain_keys_need_no_collated_join(spark):
    held = claims.claims_of(spark.createDataFrame([(1, "Ann")], "user_id int, username string"), F.lit(0), F.col("user_id"), [(0, insensitive("username"))]).drop("id")
    asked = claims.claims_of(spark.createDataFrame([(5, "ANN")], "request_id long, username string"), F.col("request_id"), F.lit("new 5"), [(0, insensitive("username"))])
    asked, held = claims._binary(asked, held)
    assert [r.key for r in asked.unionByName(held, allowMissingColumns=True).collect()] == ["ann", "ann"]
    for df in (asked, held):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def replayed(emails, patches):
    """Patches (id, user, email) one by one over {user: email}: the refused ids and the emails left."""
    emails, refused = dict(emails), []
    for change, user, email in sorted(patches):
        if user not in emails:
            continue
        if any(e.lower() == email.lower() for u, e in emails.items() if u != user):
            refused.append(change)
        else:
            emails[user] = email
    return refused, emails


def check_email_patches(spark, emails, patches):
    users = spark.createDataFrame([(u, f"name{u}", e) for u, e in emails.items()], "user_id int, username string, email string")
    probe = spark.createDataFrame([(c, u, ["email"], e) for c, u, e in patches], "change_id long, pk int, set_fields array<string>, email string")
    new, rejected = changes.apply_patches("user", users, probe, NOW_S)
    refused, left = replayed(emails, patches)
    got = {r.change_id: list(r.reasons) for r in rejected.collect()}
    assert sorted(c for c, r in got.items() if r == ["email:duplicate"]) == refused
    assert {c for c, r in got.items() if r == ["user_id:not_found"]} == {c for c, u, _ in patches if u not in emails}
    assert {r.user_id: r.email for r in new.collect()} == left


def test_emails_are_swapped_and_freed_one_by_one(spark):
    emails = {1: "a@x.org", 2: "b@x.org", 3: "c@x.org", 4: "d@x.org"}
    check_email_patches(spark, emails, [
        (1, 1, "b@x.org"), (2, 1, "t@x.org"), (3, 2, "A@x.org"), (4, 1, "B@x.org"),    # a swap through a third address
        (5, 3, "t@x.org"), (6, 4, "c@x.org"), (7, 3, "C@X.org"), (8, 9, "z@x.org"),    # freed, taken, an unknown row
        (9, 2, "z@x.org"), (10, 2, "z@X.org"), (11, 4, "A@x.org"), (12, 1, "d@x.org")])


def test_long_chains_of_emails_are_exact(spark):
    n = 1000
    emails = {k: f"e{k}@x.org" for k in range(n)}
    check_email_patches(spark, emails, [(0, 0, "free@x.org"), *((k, k, f"e{k - 1}@x.org") for k in range(1, n))])       # each frees the next one's
    check_email_patches(spark, emails, [(0, 0, "e1@x.org"), *((k, k, f"e{k - 1}@x.org") for k in range(1, n))])         # the first is refused, and so all


def test_random_email_patches_match_a_replay(spark):
    import random
    r = random.Random(3)
    for users, values, n in ((6, 9, 80), (40, 50, 300), (5, 400, 400)):
        emails = {u: f"v{u}@x.org" for u in range(users)}
        check_email_patches(spark, emails, [(c, r.randrange(users + 1) if c % 3 else 0, f"V{r.randrange(values) if c % 4 else 7}@x.org") for c in range(n)])


def test_patch_back_and_forth_moves_the_instant_and_unknown_parent_is_refused(spark):
    import datetime

    old = datetime.datetime(2020, 1, 1)
    issue = spark.createDataFrame([(1, "Low", None, old), (2, "Low", None, old)], "issue_id int, priority string, parent_issue_id int, updated_date timestamp")
    patches = spark.createDataFrame([(1, 1, ["priority"], "High", None), (2, 1, ["priority"], "Low", None), (3, 2, ["priority"], "Low", None),
                                     (4, 2, ["parent_issue_id"], None, 99), (5, 1, ["parent_issue_id"], None, 2)],
                                    "change_id int, pk int, set_fields array<string>, priority string, parent_issue_id int")
    new, bad = changes.apply_patches("issue", issue, patches, "2024-01-01 00:00:00")
    got = {r.issue_id: (r.priority, r.parent_issue_id, r.updated_date.year) for r in new.collect()}
    assert got == {1: ("Low", 2, 2024), 2: ("Low", None, 2020)}
    assert [(r.change_id, list(r.reasons)) for r in bad.collect()] == [(4, ["parent_issue_id:unknown_parent"])]


def test_patches_of_some_columns_are_judged_by_all_fields(spark):
    logs = spark.createDataFrame([(1, 5, 2, "3.00", "2024-01-01"), (2, 5, None, "4.00", "2024-01-01"), (3, 6, 2, "5.00", "2024-01-01")],
                                 "worklog_id long, issue_id int, user_id int, h string, d string").selectExpr(
        "worklog_id", "issue_id", "user_id", "CAST(h AS DECIMAL(5,2)) AS hours_logged", "CAST(d AS DATE) AS work_date")
    patches = spark.createDataFrame([(1, 1, ["hours_logged", "work_date"], "7", None), (2, 2, ["hours_logged"], "8", None),
                                     (3, 3, ["work_date"], None, "2024-02-02")],
                                    "change_id long, pk long, set_fields array<string>, h string, d string").selectExpr(
        "change_id", "pk", "set_fields", "CAST(h AS DECIMAL(20,6)) AS hours_logged", "CAST(d AS DATE) AS work_date")
    whole, refused = changes.apply_patches("worklog", logs, patches, NOW_S)
    some, also = changes.apply_patches("worklog", logs.drop("work_date"), patches, NOW_S, whole=False)
    assert sorted(some.collect()) == sorted(whole.drop("work_date").collect())
    assert [r["change_id"] for r in refused.collect()] == [r["change_id"] for r in also.collect()] == [1]


def test_only_named_keys_of_a_cascade_are_written(spark, monkeypatch):
    issue = spark.createDataFrame([(1, 1, None), (2, 2, 1)], "issue_id int, project_id int, parent_issue_id int")
    tables = {"project": spark.createDataFrame([(1,), (2,)], "project_id int"), "issue": issue,
              "worklog": spark.createDataFrame([(1, 1), (2, 2)], "worklog_id long, issue_id int")}
    kind, written = type(issue), []
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, eager=True: written.append(df.columns) or real(df, eager))
    new, report = changes.delete_cascade(tables, "project", spark.createDataFrame([(1,)], "pk int"), materialize=("project", "issue"))
    assert written == [["project_id"], ["issue_id"]]
    assert [tuple(r) for r in new["worklog"].collect()] == [(2, 2)] and [tuple(r) for r in new["issue"].collect()] == [(2, 2, None)]
    assert ("worklog", "deleted", 1) in [tuple(r) for r in report.collect()]
