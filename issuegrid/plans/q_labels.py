"""Registered queries for display and clean-up columns (X1–X17), each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as X
from ..operators import enrich, reports
from .catalog import query


@query("issue_code")
def issue_code(t):
    """KEY-id for every issue."""
    i = enrich.issue_enriched(t["issue"], t["project"], t["sprint"], t["user"])
    return i.select("issue_id", X.issue_code("project_key", "issue_id").alias("issue_code"))


@query("short_description")
def short_description(t):
    """First 50 characters of every description, '...' only when cut."""
    return t["issue"].select("issue_id", X.short_description("description").alias("short_description"))


@query("parent_label")
def parent_label(t):
    """The parent-picker label of every issue."""
    i = enrich.issue_enriched(t["issue"], t["project"], t["sprint"], t["user"])
    return i.select("issue_id", X.parent_label("project_key", "issue_id", "description").alias("parent_label"))


@query("fallback_labels")
def fallback_labels(t):
    """Issue-card labels with the page fallbacks."""
    i = enrich.issue_enriched(t["issue"], t["project"], t["sprint"], t["user"])
    return i.select(
        "issue_id",
        X.or_label("assignee_username", X.FALLBACK["assignee"]).alias("assignee_label"),
        X.or_label("sprint_name", X.FALLBACK["sprint"]).alias("sprint_label"),
        X.or_label("reporter_username", X.FALLBACK["reporter"]).alias("reporter_label"),
        X.story_points_label("story_points").alias("story_points_label"))


@query("worklog_labels")
def worklog_labels(t):
    """Worklog row labels (logger, description, hours, work date)."""
    w = enrich.worklog_enriched(t["worklog"], t["user"])
    return w.select(
        "worklog_id",
        X.or_label("logger_username", X.FALLBACK["logger"]).alias("logger_label"),
        X.or_label("description", X.FALLBACK["worklog_description"]).alias("description_label"),
        X.hours_label("hours_logged").alias("hours_label"),
        X.date_label("work_date").alias("work_date_label"))


@query("comment_labels")
def comment_labels(t):
    """Comment header labels (author, time)."""
    c = enrich.comment_enriched(t["comment"], t["user"])
    return c.select(
        "comment_id",
        X.or_label("author_username", X.FALLBACK["comment_author"]).alias("author_label"),
        X.datetime_label("created_at").alias("created_label"))


@query("sprint_labels")
def sprint_labels(t):
    """Sprint card labels (goal, status, dates)."""
    return t["sprint"].select(
        "sprint_id",
        X.or_label("goal", X.FALLBACK["sprint_goal"]).alias("goal_label"),
        X.capitalize("status").alias("status_label"),
        X.date_label("start_date").alias("start_label"),
        X.date_label("end_date").alias("end_label"))


@query("capitalize")
def capitalize(t):
    """Capitalised role of every user ('project_manager' → 'Project_manager')."""
    return t["user"].select("user_id", X.capitalize("role").alias("role_label"))


@query("full_name")
def full_name(t):
    """First + ' ' + last of every user, nulls as ''."""
    return t["user"].select("user_id", X.full_name("first_name", "last_name").alias("full_name"))


@query("date_label")
def date_label(t):
    """Due-date label of every issue ('N/A' when unset)."""
    return t["issue"].select("issue_id", X.date_label("due_date").alias("due_label"))


@query("datetime_label")
def datetime_label(t):
    """Creation time label of every issue."""
    return t["issue"].select("issue_id", X.datetime_label("created_date").alias("created_label"))


@query("hours_label")
def hours_label(t):
    """Two-decimal total hours of every issue (A1)."""
    h = reports.issue_hours(t["issue"], t["worklog"])
    return h.select("issue_id", X.hours_label("total_hours").alias("hours_label"))


@query("round_hours")
def round_hours(t):
    """Each worklog split in four equal parts, rounded half-even to 2 places."""
    return t["worklog"].select("worklog_id", X.round_hours(F.col("hours_logged") * F.lit(0.25).cast("decimal(3,2)"))
                               .alias("quarter_hours"))


@query("safe_file_name")
def safe_file_name(t):
    """X11: safe stored name of every attachment's file name."""
    return t["attachment"].select("attachment_id", X.safe_file_name("file_name").alias("safe_name"))


@query("stored_path")
def stored_path(t):
    """Reproducible stored path of every attachment (token from SHA-256 of id and name)."""
    seed = F.concat_ws("_", F.col("attachment_id").cast("string"), F.col("file_name"))
    return t["attachment"].select("attachment_id", X.stored_path("file_name", seed).alias("stored_path"))


@query("download_url")
def download_url(t):
    """Download link and media type of every attachment."""
    return t["attachment"].select("attachment_id", X.download_url("attachment_id").alias("download_url"),
                                  X.media_type("file_type").alias("media_type"))


@query("blank_to_null")
def blank_to_null(t):
    """Worklog descriptions with '' as null, and whether each has text."""
    w = t["worklog"].select("worklog_id", X.blank_to_null("description").alias("description"),
                            F.coalesce(X.non_blank("description"), F.lit(False)).alias("has_text"))
    return w


@query("text_to_int")
def text_to_int(t):
    """Form texts as integers: whole numbers up to the largest INT, else null."""
    digits = F.concat(F.lit(" "), ((F.col("worklog_id") % 4001) * 1_000_003).cast("string"), F.lit("\t"))
    text = F.when(F.col("worklog_id") % 7 == 0, F.concat(F.col("worklog_id").cast("string"), F.lit("abc"))).otherwise(digits)
    return t["worklog"].select("worklog_id", X.text_to_int(text).alias("number"))
