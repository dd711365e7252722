"""J11 as a running audit: files and attachment records that arrive as streams.

The batch audit compares a whole listing with all records. Here both sides arrive: a file
in the store and the record that points to it are matched by a full outer stream-stream
join on the stored name. They must come within ``wait`` of each other; a side whose partner
has not come when the watermark passes that time is reported, once, as ``orphan_file`` or
``missing_file``. State holds only files and records younger than ``wait`` plus ``delay``
that wait for a partner or a repeat.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.files import stored_name
from ..session import checkpoint_dir
from .activity import catch_up

FILES = "stored_name string, size_bytes long, arrived_at timestamp"
RECORDS = "attachment_id long, issue_id int, file_path string, uploaded_at timestamp"
FINDINGS = ["kind", "stored_name", "size_bytes", "attachment_id", "issue_id"]
END_OF_TIME = "3000-01-01 00:00:00"       # the time of the marks that end an audit


def running_audit(files: DataFrame, records: DataFrame, delay: str, wait: str) -> DataFrame:
    """``(kind, stored_name, size_bytes, attachment_id, issue_id)`` of the files without record
    and the records without file, from streams ``FILES`` and ``RECORDS``.

    ``delay`` bounds how far either stream runs out of time order. Rows without a time cannot
    be matched in time and are left out; a record without a path has no file. Rows
    without name and id (the marks of :func:`finish`) only move the watermark.
    """
    left = files.where(F.col("arrived_at").isNotNull()).withWatermark("arrived_at", delay)
    right = (records.where(F.col("uploaded_at").isNotNull())
             .select("attachment_id", "issue_id", stored_name("file_path").alias("record_name"), "uploaded_at")
             .withWatermark("uploaded_at", delay))
    near = F.expr(f"stored_name = record_name AND uploaded_at >= arrived_at - INTERVAL {wait} AND uploaded_at <= arrived_at + INTERVAL {wait}")
    kind = (F.when(F.col("attachment_id").isNull() & F.col("stored_name").isNotNull(), F.lit("orphan_file"))
            .when(F.col("stored_name").isNull() & F.col("attachment_id").isNotNull(), F.lit("missing_file")))
    return left.join(right, near, "full_outer").select(
        kind.alias("kind"), F.coalesce("stored_name", "record_name").alias("stored_name"), "size_bytes",
        "attachment_id", "issue_id").where(F.col("kind").isNotNull())


def findings(spark: SparkSession, base: str) -> DataFrame:
    """What the audit under ``base`` has reported so far; a side delivered twice counts once."""
    return spark.read.parquet(os.path.join(base, "sink")).select(*FINDINGS).distinct()


def finish(spark: SparkSession, files_dir: str, records_dir: str) -> None:
    """Land a mark in both folders that ends the audit: its time lies behind all others, so the
    next run reports all sides still waiting. Whatever arrives after it is too late."""
    end = F.lit(END_OF_TIME).cast("timestamp")
    for path, schema, time in ((files_dir, FILES, "arrived_at"), (records_dir, RECORDS, "uploaded_at")):
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = dict(c.split() for c in schema.split(", "))
        spark.range(1).select(*[end.alias(c) if c == time else F.lit(None).cast(kinds[c]).alias(c) for c in names]).write.mode(
            "append").parquet(path)


def audit_until_finished(spark: SparkSession, files_dir: str, records_dir: str, delay: str, wait: str,
                         work_dir: str | None = None, max_files_per_trigger: int = 1000) -> DataFrame:
    """Run the audit over everything landed in both folders, end it and return its findings.
    Sink and checkpoint live under ``work_dir`` (default: a new folder in the session's
    shared checkpoint folder)."""
    base = work_dir or os.path.join(checkpoint_dir(spark), f"audit-{uuid.uuid4().hex[:12]}")

    def run():
        files, records = (spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files_per_trigger)).parquet(path)
                          for path, schema in ((files_dir, FILES), (records_dir, RECORDS)))
        catch_up(spark, running_audit(files, records, delay, wait), base, delay, mode="append")

    run()
    finish(spark, files_dir, records_dir)
    run()
    return findings(spark, base)
