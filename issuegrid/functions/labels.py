"""Display and clean-up columns, as plain Spark column expressions.

All are JVM-side built-ins, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HOURS_SUM

# --- fixed values: display texts of the pages ---------------------------------
FALLBACK = {
    "assignee": "Unassigned",
    "sprint": "Backlog",
    "reporter": "Unknown",
    "logger": "Unknown",
    "uploader": "Unknown",
    "comment_author": "Unknown User",
    "worklog_description": "No description.",
    "sprint_goal": "No goal set.",
    "story_points": "Not set",
    "date": "N/A",
    "file_name": "attached_file",
    "missing_file_name": "unknown_file",
    "media_type": "application/octet-stream",
}
SHORT_LENGTH = 50
PARENT_PREFIX_LENGTH = 30
ELLIPSIS = "..."
DATE_FORMAT = "MMM d, yyyy"
DATETIME_FORMAT = "MMM d, yyyy, h:mm a"
DOWNLOAD_URL = "/api/attachments/{id}/download"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_label(c: str | Column, label: str) -> Column:
    """``value || 'label'`` of the pages: null and empty text both take the label."""
    c = _c(c)
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit(label)).otherwise(c.cast("string"))


def issue_code(project_key: str | Column, issue_id: str | Column) -> Column:
    """``KEY-123``."""
    return F.concat_ws("-", _c(project_key), _c(issue_id).cast("string"))


def short_description(c: str | Column, n: int = SHORT_LENGTH) -> Column:
    """First ``n`` characters, ``...`` only when longer."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ELLIPSIS))).otherwise(c)


def parent_label(project_key: str | Column, issue_id: str | Column, description: str | Column,
                 n: int = PARENT_PREFIX_LENGTH) -> Column:
    """``KEY-id (first 30...)`` — the ellipsis is always added."""
    return F.concat(issue_code(project_key, issue_id), F.lit(" ("), F.substring(_c(description), 1, n),
                    F.lit(ELLIPSIS + ")"))


def story_points_label(c: str | Column) -> Column:
    """X4 (story points): 'Not set' for null and for 0."""
    c = _c(c)
    return F.when(c.isNull() | (c == 0), F.lit(FALLBACK["story_points"])).otherwise(c.cast("string"))


def capitalize(c: str | Column) -> Column:
    """Upper-case the first character only; null or empty gives ''."""
    c = _c(c)
    return F.when(c.isNull() | (F.length(c) == 0), F.lit("")).otherwise(
        F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2 ** 31 - 1)))


def full_name(first: str | Column, last: str | Column) -> Column:
    """``first + ' ' + last`` with nulls as '' and no trimming."""
    return F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" "), F.coalesce(_c(last), F.lit("")))


def date_label(c: str | Column) -> Column:
    """X7: 'Nov 20, 2025'; null gives 'N/A'."""
    return F.coalesce(F.date_format(_c(c), DATE_FORMAT), F.lit(FALLBACK["date"]))


def datetime_label(c: str | Column) -> Column:
    """X8: 'Oct 30, 2025, 2:30 PM' in the session time zone; null gives 'N/A'."""
    return F.coalesce(F.date_format(_c(c), DATETIME_FORMAT), F.lit(FALLBACK["date"]))


def hours_label(c: str | Column) -> Column:
    """Hours with exactly two decimals ('7.25', '0.00')."""
    return _c(c).cast(HOURS_SUM).cast("string")


def round_hours(c: str | Column) -> Column:
    """Hours rounded half-even to 2 places on the decimal value.

    Takes DECIMAL or text input; a binary double such as 2.675 is first read as
    the decimal it prints as, so the result is 2.68 (Python's float rounding
    would give 2.67 from the binary value)."""
    return F.bround(_c(c).cast("string").cast("decimal(20,6)"), 2).cast("decimal(7,2)")


def safe_file_name(c: str | Column) -> Column:
    """X11: keep letters, digits and ``. _ -``; empty → 'attached_file';
    missing name → 'unknown_file'."""
    c = _c(c)
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "")
    return (F.when(c.isNull(), F.lit(FALLBACK["missing_file_name"]))
            .when(kept == "", F.lit(FALLBACK["file_name"]))
            .otherwise(kept))


def stored_path(file_name: str | Column, seed: str | Column | None = None) -> Column:
    """``<token>_<safe name>``. With ``seed`` the token is the first 32 hex
    digits of SHA-256 of ``seed`` (reproducible); without, a random UUID."""
    token = F.expr("uuid()") if seed is None else F.substring(F.sha2(_c(seed).cast("string"), 256), 1, 32)
    return F.concat(token, F.lit("_"), safe_file_name(file_name))


def download_url(attachment_id: str | Column) -> Column:
    """``/api/attachments/{id}/download``."""
    head, tail = DOWNLOAD_URL.split("{id}")
    return F.concat(F.lit(head), _c(attachment_id).cast("string"), F.lit(tail))


def media_type(c: str | Column) -> Column:
    """Stored file type, 'application/octet-stream' when missing or empty."""
    return or_label(c, FALLBACK["media_type"])


def blank_to_null(c: str | Column) -> Column:
    """X15: '' becomes null (form fields are sent as null when left empty)."""
    return F.nullif(_c(c), F.lit(""))


def text_to_int(c: str | Column) -> Column:
    """Form text to an integer id / points; anything not a whole number
    (including '5abc', which the page's parser would accept) or outside INT gives null."""
    return F.regexp_extract(_c(c), r"\A\s*([+-]?[0-9]+)\s*\z", 1).try_cast("int")


def non_blank(c: str | Column) -> Column:
    """True when the text has a character other than white space (as the page's trim
    takes it: also no-break, line and other Unicode spaces)."""
    return _c(c).rlike(r"[^\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")


def now_param(ts: str) -> Column:
    """The run's 'current time' as a parameter (repeatable runs)."""
    return F.lit(ts).cast("timestamp")
