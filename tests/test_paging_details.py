from pyspark.sql import functions as F

from conftest import SF_SMALL
from edge_rows import base_tables

from issuegrid.operators import details, paging
from issuegrid.sources.fixture import fixture_tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyset_paging_equals_offset_paging(spark):
    t = fixture_tables(spark, SF_SMALL, ["issue"])
    order = paging.ORDERS["project_issues"]
    issues = t["issue"].filter(F.col("project_id") == 3)
    offset_rows = [r.issue_id for r in paging.page(issues, order, 0, 250).collect()]
    seen, last = [], None
    while True:
        page = paging.page_after(issues, order, last, 40).collect()
        if not page:
            break
        seen += [r.issue_id for r in page]
        last = {c: page[-1][c] for c, _ in order}
    assert seen == offset_rows[: len(seen)] and len(seen) == issues.count()


def test_top_k_per_parent_matches_single_pages(spark):
    t = fixture_tables(spark, SF_SMALL, ["issue"])
    order = paging.ORDERS["project_issues"]
    topk = paging.top_k_per_parent(t["issue"], "project_id", order, skip=5, limit=10)
    for pid in (0, 3, 7):
        page = [r.issue_id for r in paging.page(t["issue"].filter(F.col("project_id") == pid), order, 5, 10).collect()]
        got = [r.issue_id for r in topk.filter(F.col("project_id") == pid).orderBy("rn").collect()]
        assert got == page
    assert "WindowGroupLimit" in _plan(topk)


def test_issue_document_lists_bounded_and_ordered(spark):
    t = base_tables(spark)
    doc = details.issue_details(t["issue"], t["project"], t["sprint"], t["user"], t["comment"], t["worklog"],
                                t["attachment"], limit=2)
    d = {r.issue_id: r for r in doc.collect()}
    assert [w.worklog_id for w in d[1].worklogs] == [3, 1]          # latest work date first, capped at 2
    assert str(d[1].total_hours) == "7.25"                          # total over all worklogs
    assert d[3].comments == [] and d[3].worklogs == [] and d[3].attachments == []
    assert [c.author_username for c in d[1].comments] == ["ann"]
    flat = details.explode_details(doc)
    assert flat.filter(F.col("issue_id") == 3).count() == 3


def test_issue_document_with_child_ids_beyond_int(spark):
    t = base_tables(spark)
    far = t["worklog"].withColumn("worklog_id", F.col("worklog_id") + 5_000_000_000)
    doc = details.issue_details(t["issue"], t["project"], t["sprint"], t["user"], t["comment"], far, t["attachment"])
    got = {r.child_id for r in details.explode_details(doc).filter("kind = 'worklogs' and child_id is not null").collect()}
    assert got == {r.worklog_id for r in far.collect()}


def test_p3_sprint_order_null_dates_last(spark):
    import datetime as dt

    from edge_rows import T0, table

    s = table(spark, "sprint", [
        dict(sprint_id=1, project_id=1, sprint_name="a", status="future", start_date=None, created_at=T0),
        dict(sprint_id=2, project_id=1, sprint_name="b", status="active", start_date=dt.date(2025, 1, 1),
             created_at=T0),
        dict(sprint_id=3, project_id=1, sprint_name="c", status="active", start_date=dt.date(2025, 3, 1),
             created_at=T0),
        dict(sprint_id=4, project_id=1, sprint_name="d", status="active", start_date=dt.date(2025, 3, 1),
             created_at=T0 + dt.timedelta(days=1)),
    ])
    assert [r.sprint_id for r in paging.page_project_sprints(s, 1).collect()] == [4, 3, 2, 1]
    assert [r.sprint_id for r in paging.page_project_sprints(s, 1, skip=1, limit=2).collect()] == [3, 2]


def test_keyset_paging_through_nulls(spark):
    t = fixture_tables(spark, SF_SMALL, ["sprint"])
    order = paging.ORDERS["sprints"]                      # start_date desc (nulls last), created_at desc, id
    sprints = t["sprint"]
    expected = [r.sprint_id for r in paging.page(sprints, order, 0, 1000).collect()]
    assert sprints.filter(F.col("start_date").isNull()).count() > 0
    seen, last = [], None
    while True:
        rows = paging.page_after(sprints, order, last, 7).collect()
        if not rows:
            break
        seen += [r.sprint_id for r in rows]
        last = {c: rows[-1][c] for c, _ in order}
    assert seen == expected
