"""Registered queries for sources and sinks (S1–S5), the file audit (J11) and
the streaming roll-ups (ST1, ST2). They write to fresh folders under the
session's shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import labels as X
from ..operators import changes, enrich, files
from ..session import checkpoint_dir
from ..sources import files as listing
from ..sources import tables as io
from ..sources.filestore import write_files
from ..streaming import activity, audit
from .catalog import query

TABLES = ("user", "project", "sprint", "issue", "comment", "attachment", "worklog")


def _fresh(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def _upload_name(df):
    """The stored name an upload of each attachment gets (X12, reproducible seed)."""
    seed = F.concat_ws("_", F.col("attachment_id").cast("string"), F.col("file_name"))
    return X.stored_path("file_name", seed)


@query("base_table_scan")
def base_table_scan(t):
    """S1+S4: all seven tables written as Parquet and scanned back with the fixed
    schema; rows per table."""
    spark = t["issue"].sparkSession
    root = _fresh(spark, "tables")
    io.save_tables({k: t[k] for k in TABLES}, root)
    loaded = io.load(spark, root)
    parts = [df.groupBy().agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in loaded.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("append_rows")
def append_rows(t):
    """S3: accepted new worklogs (D1) appended to the stored worklog table."""
    spark = t["issue"].sparkSession
    path = os.path.join(_fresh(spark, "append"), "worklog.parquet")
    io.replace(io.conform(t["worklog"], "worklog"), path)
    ok, _ = changes.insert_rows("worklog", t["new_worklog"], {k: t[k] for k in TABLES}, changes.DEFAULT_NOW,
                                acting_user="user_id")
    io.append(io.conform(ok, "worklog"), path)
    stored = io.conform(spark.read.parquet(path), "worklog")
    return stored.groupBy().agg(F.count(F.lit(1)).alias("row_count"),
                                F.sum("hours_logged").cast("decimal(18,2)").alias("total_hours"))


@query("export_json")
def export_json(t):
    """Enriched issues exported as JSON documents (nulls kept) and read back."""
    spark = t["issue"].sparkSession
    path = _fresh(spark, "json")
    docs = enrich.issue_enriched(t["issue"], t["project"], t["sprint"], t["user"])
    io.export_json(docs, path)
    return spark.read.schema(docs.schema).json(path)


def _store(t):
    """Lay down the file store: every attachment's body stored under the name
    its upload produced."""
    spark = t["attachment"].sparkSession
    root = _fresh(spark, "files")
    bodies = t["attachment"].select("attachment_id", "file_name").join(t["page_body"], "attachment_id", "inner")
    write_files(bodies.withColumn("n", _upload_name(bodies)), root, "n", "body").count()
    return root


@query("list_files")
def list_files(t):
    """Listing (name, size) of a file store laid down from the page bodies."""
    spark = t["attachment"].sparkSession
    return listing.list_files(spark, _store(t)).select("stored_name", "size_bytes")


@query("orphan_files")
def orphan_files(t):
    """Files left in the store after the archived-project cascade
    deleted their attachment records."""
    spark = t["attachment"].sparkSession
    store = listing.list_files(spark, _store(t))
    after, _ = changes.delete_cascade({k: t[k] for k in TABLES}, "project", t["delete_project"])
    records = after["attachment"].withColumn("file_path", _upload_name(after["attachment"]))
    return files.orphan_files(store, records).select("stored_name", "size_bytes")


def _base(t):
    return {k: t[k] for k in TABLES}


def _recorded(t):
    """The attachments that the activity batch records (D1, ids by D2)."""
    requests = t["new_attachment"].withColumn("file_path", X.stored_path(
        "file_name", F.concat_ws("_", F.col("request_id").cast("string"), F.col("file_name"))))
    return changes.insert_rows("attachment", requests, _base(t), changes.DEFAULT_NOW, acting_user="user_id")[0]


@query("missing_files")
def missing_files(t):
    """Attachment records without a stored file — the attachments the
    activity batch recorded (D1, ids by D2) whose upload never reached the store."""
    spark = t["attachment"].sparkSession
    store = listing.list_files(spark, _store(t))
    new = _recorded(t)
    current = t["attachment"].withColumn("file_path", _upload_name(t["attachment"]))
    records = current.unionByName(new.select(*current.columns))
    return files.missing_files(store, records)


def _stream(t, which, delay=None):
    spark = t["activity"].sparkSession
    events_dir = _fresh(spark, "events")
    activity.land_events(t["activity_delivered"], events_dir)
    return activity.run_until_caught_up(spark, events_dir, which, delay=delay, max_bytes_per_trigger=4 << 30)


@query("stream_issue_last_activity")
def stream_issue_last_activity(t):
    """ST1: running last touch per issue over the activity stream, some events delivered twice."""
    return _stream(t, "last_activity")


@query("stream_issue_hours")
def stream_issue_hours(t):
    """ST2: running signed worklog hours per issue (inserts add, deletes subtract),
    de-duplicated on event id: some events are delivered twice.

    The batch's events span 30 days and land in files without time order, so
    the watermark delay is set above that lateness (31 days)."""
    return _stream(t, "running_hours", delay="31 days")


@query("stream_issue_hours_keyed")
def stream_issue_hours_keyed(t):
    """ST2 on keyed state: the same totals without any lateness limit; every event id is
    remembered, and some events are delivered twice."""
    return _stream(t, "keyed_hours")


@query("stream_file_audit")
def stream_file_audit(t):
    """J11 as a running audit: uploads arrive up to 50 minutes after their records; the records
    of archived projects never come, and those of the activity batch come without a file."""
    spark = t["attachment"].sparkSession
    files_dir, records_dir = _fresh(spark, "arriving-files"), _fresh(spark, "arriving-records")
    uploads = t["attachment"].join(t["page_body"].select("attachment_id", "body"), "attachment_id")
    (uploads.select(_upload_name(uploads).alias("stored_name"), F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("size_bytes"),
                    (F.col("uploaded_at") + F.make_interval(mins=F.col("attachment_id") % 50)).alias("arrived_at"))
     .write.parquet(files_dir))
    after, _ = changes.delete_cascade(_base(t), "project", t["delete_project"])
    kept = after["attachment"].withColumn("file_path", _upload_name(after["attachment"]))
    new = _recorded(t)
    (kept.unionByName(new.select(*kept.columns))
     .select(F.col("attachment_id").cast("long").alias("attachment_id"), "issue_id", "file_path", "uploaded_at").write.parquet(records_dir))
    return audit.audit_until_finished(spark, files_dir, records_dir, delay="400 days", wait="1 hour")
