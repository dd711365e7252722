"""Stored files vs attachment records.

The reference only logs a warning when a file is missing and leaves orphans to
"a separate cleanup job". Both directions are ``left_anti`` joins between the
file listing (S2) and the records' stored names — no file body is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stored_name(path: str | Column) -> Column:
    """Last segment of a stored path (the name the listing reports)."""
    c = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(c, "/"), -1)


def orphan_files(listing: DataFrame, attachment: DataFrame) -> DataFrame:
    """Files in the store that no attachment record points to:
    ``(stored_name, size_bytes, modified_at)``."""
    names = attachment.select(stored_name("file_path").alias("stored_name"))
    return listing.join(names, "stored_name", "left_anti").select("stored_name", "size_bytes", "modified_at")


def missing_files(listing: DataFrame, attachment: DataFrame) -> DataFrame:
    """Attachment records whose file is not in the store:
    ``(attachment_id, issue_id, file_path)``."""
    rec = attachment.select("attachment_id", "issue_id", "file_path", stored_name("file_path").alias("stored_name"))
    return rec.join(listing.select("stored_name"), "stored_name", "left_anti").select(
        "attachment_id", "issue_id", "file_path")
