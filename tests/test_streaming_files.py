import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from edge_rows import base_tables

from issuegrid.operators import files, reports
from issuegrid.sources import files as listing
from issuegrid.sources.filestore import write_files
from issuegrid.streaming import activity

SCHEMA = "event_id long, ts timestamp, user_id int, issue_id int, kind string, hours decimal(5,2)"


def _events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_stream_equals_batch_with_reordered_files_and_repeats(spark):
    base = dt.datetime(2025, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=(i * 37) % 500), 1, i % 7,
             ["comment_insert", "worklog_insert", "worklog_update", "worklog_delete"][i % 4],
             Decimal(i % 9 + 1)) for i in range(200)]
    d = tempfile.mkdtemp(prefix="events-", dir="/tmp")
    # newest events land first, then older ones, then 100 repeated events
    activity.land_events(_events(spark, rows[100:]), d, files=2)
    activity.land_events(_events(spark, rows[:100]), d, files=2)
    activity.land_events(_events(spark, rows[:100]), d, files=1)
    batch = _events(spark, rows)
    last = activity.run_until_caught_up(spark, d, "last_activity", max_files_per_trigger=1)
    expect_last = reports.last_touch(batch).withColumnRenamed("last_touch", "last_activity")
    assert sorted(last.collect()) == sorted(expect_last.collect())
    hours = activity.run_until_caught_up(spark, d, "running_hours", delay="1 day", max_files_per_trigger=1)
    expect = reports.hours_delta(spark.createDataFrame([], "issue_id int, total_hours decimal(18,2)"), batch)
    assert sorted(hours.collect()) == sorted(expect.collect())
    raw = activity.run_until_caught_up(spark, d, "running_hours", dedupe=False)
    assert sorted(raw.collect()) != sorted(expect.collect())          # repeats double-count without de-dup


def test_keyed_hours_know_repeats_however_late(spark):
    base = dt.datetime(2025, 1, 1)
    rows = [(k, base + dt.timedelta(days=n), 1, k % 3, "worklog_delete" if k % 4 == 3 else "worklog_insert", Decimal("1.25") * k)
            for k, n in enumerate([0, 400, 3, 800, 1, 2, 900, 5])]
    odd = [(None, base, 1, 1, "worklog_insert", Decimal(5)), (90, base, 1, None, "worklog_insert", Decimal(5)),
           (91, base, 1, 2, "worklog_insert", None), (92, None, 1, 2, "worklog_insert", Decimal(2)), (93, base, 1, 2, "comment_insert", None)]
    d = tempfile.mkdtemp(prefix="events-", dir="/tmp")
    for part in (rows, odd, rows[::-1], rows[:3]):            # repeats years behind the newest event, in later batches
        activity.land_events(_events(spark, part), d, files=1)
    got = activity.run_until_caught_up(spark, d, "keyed_hours", max_files_per_trigger=1)
    expect = {}
    for k, _, _, issue, kind, hours in [*rows, odd[2], odd[3]]:
        expect[issue] = expect.get(issue, Decimal(0)) + (hours or 0) * (1 if kind == "worklog_insert" else -1)
    assert {r.issue_id: r.total_hours for r in got.collect()} == expect


def _land_one_by_one(spark, rows, directory):
    """Each row as a file of its own, files in the order of the rows."""
    seen = set()
    for k, row in enumerate(rows):
        activity.land_events(_events(spark, [row]), directory, files=1)
        for name in set(os.listdir(directory)) - seen:
            seen.add(name)
            os.utime(os.path.join(directory, name), (1.7e9 + k, 1.7e9 + k))


def test_late_events_fail_the_run_however_many_batches_follow(spark):
    base = dt.datetime(2025, 1, 1)
    days = [0, 10, 11, 0, *range(12, 18)]                     # the fourth comes ten days behind
    rows = [(k, base + dt.timedelta(days=n), 1, k % 3, "worklog_insert", Decimal(1)) for k, n in enumerate(days)]
    d = tempfile.mkdtemp(prefix="events-", dir="/tmp")
    _land_one_by_one(spark, rows, d)
    key = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")                                  # fewer than the batches after the late one
    try:
        with pytest.raises(RuntimeError, match="1 events came later than 1 day"):
            activity.run_until_caught_up(spark, d, "running_hours", delay="1 day", max_files_per_trigger=1)
        whole = activity.run_until_caught_up(spark, d, "running_hours", delay="30 days", max_files_per_trigger=1)
        assert sorted(map(tuple, whole.collect())) == [(0, Decimal(4)), (1, Decimal(3)), (2, Decimal(3))]
    finally:
        spark.conf.set(key, before)


def test_a_missing_report_fails_the_run(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="events-", dir="/tmp")
    activity.land_events(_events(spark, [(1, dt.datetime(2025, 1, 1), 1, 1, "worklog_insert", Decimal(1))]), d, files=1)
    monkeypatch.setattr(activity._LateRows, "onQueryProgress", lambda self, event: None)
    with pytest.raises(RuntimeError, match="no report of micro-batches"):
        activity.run_until_caught_up(spark, d, "running_hours", delay="1 day")


def test_file_audit_both_directions(spark):
    t = base_tables(spark)
    store = tempfile.mkdtemp(prefix="store-", dir="/tmp")
    body = spark.createDataFrame([("u1_a.txt", "abc"), ("stray.bin", "zz")], "n string, b string")
    assert write_files(body, store, "n", "b").count() == 2
    lst = listing.list_files(spark, store)
    assert {(r.stored_name, r.size_bytes) for r in lst.collect()} == {("u1_a.txt", 3), ("stray.bin", 2)}
    extra = t["attachment"].unionByName(t["attachment"].select(
        F.lit(2).alias("attachment_id"), *[c for c in t["attachment"].columns if c != "attachment_id"])
        .withColumn("file_path", F.lit("uploads/u2_b.txt")))
    assert [r.stored_name for r in files.orphan_files(lst, extra).collect()] == ["stray.bin"]
    assert [r.attachment_id for r in files.missing_files(lst, extra).collect()] == [2]
    assert os.path.exists(os.path.join(store, "u1_a.txt"))


def test_compaction_keeps_the_current_table(spark):
    base_ts = dt.datetime(2025, 1, 1)
    rows = [(i, base_ts + dt.timedelta(minutes=i), 1, i % 5, "worklog_insert", Decimal(i % 4 + 1)) for i in range(60)]
    root = tempfile.mkdtemp(prefix="compact-", dir="/tmp")
    events, work = os.path.join(root, "events"), os.path.join(root, "work")
    activity.land_events(_events(spark, rows[:30]), events, files=2)
    activity.run_until_caught_up(spark, events, "running_hours", work_dir=work, delay="1 day")
    sink = os.path.join(work, "sink")
    base = activity.compact(spark, sink, "issue_id", ["total_hours"], os.path.join(root, "base1"))
    activity.land_events(_events(spark, rows[30:]), events, files=2)
    activity.run_until_caught_up(spark, events, "running_hours", work_dir=work, delay="1 day")
    got = activity.current_table(spark, sink, "issue_id", ["total_hours"], base=base)
    expect = reports.hours_delta(spark.createDataFrame([], "issue_id int, total_hours decimal(18,2)"),
                                 _events(spark, rows))
    assert sorted(got.collect()) == sorted(expect.collect())
    assert sorted(activity.current_table(spark, sink, "issue_id", ["total_hours"]).collect()) == sorted(got.collect())


def test_running_audit_reports_each_unmatched_side_once(spark):
    from issuegrid.streaming import audit

    t0 = dt.datetime(2025, 1, 1)
    at = lambda minutes: t0 + dt.timedelta(minutes=minutes)
    stored = [("a", 1, at(0)), ("b", 2, at(5)), ("c", 3, at(0)), ("d", 4, at(9)), ("d", 4, at(9)), ("f", 6, None)]
    records = [(1, 10, "up/a", at(30)), (2, 10, "up/b", at(-20)), (3, 11, "up/c", at(61)), (4, 11, "up/e", at(3)),
               (4, 11, "up/e", at(3)), (5, 12, None, at(4)), (6, 12, "up/f", at(8))]
    where = [tempfile.mkdtemp(prefix="audit-", dir="/tmp") for _ in range(2)]
    for path, rows, schema in ((where[0], stored, audit.FILES), (where[1], records, audit.RECORDS)):
        for part in (rows[::2], rows[1::2]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    got = audit.audit_until_finished(spark, *where, delay="2 hours", wait="1 hour", max_files_per_trigger=1)
    assert sorted((r.kind, r.stored_name, r.size_bytes, r.attachment_id) for r in got.collect() if r.stored_name) == [
        ("missing_file", "c", None, 3), ("missing_file", "e", None, 4), ("missing_file", "f", None, 6),   # f's file has no time
        ("orphan_file", "c", 3, None), ("orphan_file", "d", 4, None)]                                     # c's record came 61 minutes on
    assert [r.attachment_id for r in got.collect() if r.stored_name is None] == [5]                       # a record without a path
