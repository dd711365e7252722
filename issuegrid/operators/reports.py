"""Hour reports, counts and activity roll-ups, for all keys at once.

Plans aggregate before they join, so the fact table is reduced map-side
(partial aggregation) before it is shuffled: a hot key (one issue or project
with a third of all rows) only makes one partial aggregate larger. A2 sums per
issue before the issue join; A3 sums per (issue, user) before it, so a hot
issue reaches the join as one row per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import HOURS_SIGN, HOURS_SUM, TOUCHING_KINDS
from .common import hours_sum, restrict, zero_hours
from .enrich import worklog_with_project


def issue_hours(issue: DataFrame, worklog: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """A1: ``(issue_id, total_hours)`` for every issue; no worklog gives 0.00."""
    per_issue = worklog.groupBy("issue_id").agg(hours_sum("hours_logged").alias("total_hours"))
    issues = restrict(issue.select("issue_id"), keys, "issue_id")
    return (issues.join(per_issue, "issue_id", "left")
            .select("issue_id", F.coalesce("total_hours", zero_hours()).alias("total_hours")))


def project_hours(project: DataFrame, issue: DataFrame, worklog: DataFrame,
                  keys: DataFrame | None = None) -> DataFrame:
    """A2: ``(project_id, total_hours)`` over all worklogs of the project's issues.

    Worklogs of deleted users count (no user join). Aggregated per issue first,
    so the join to issues sees one row per issue, then per project.
    """
    per_issue = worklog.groupBy("issue_id").agg(F.sum("hours_logged").alias("h"))
    per_project = (worklog_with_project(per_issue, issue)
                   .groupBy("project_id").agg(hours_sum("h").alias("total_hours")))
    projects = restrict(project.select("project_id"), keys, "project_id")
    return (projects.join(per_project, "project_id", "left")
            .select("project_id", F.coalesce("total_hours", zero_hours()).alias("total_hours")))


def hours_by_user(issue: DataFrame, worklog: DataFrame, user: DataFrame,
                  keys: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """A3 (flagship): ``(project_id, user_id, username, total_user_hours)``.

    Same rows as ``worklog JOIN user JOIN issue GROUP BY project, user``: worklogs
    with a null or unknown user are dropped by the INNER user join. Worklogs are
    first summed per (issue, user) — partial aggregation, so a hot issue reaches
    the issue join as one row per user, not as its raw worklogs — then joined to
    their issue, summed per (project, user), and only then joined to the
    usernames. Ordered by hours desc within a project, ``user_id`` breaking ties.
    """
    issues = restrict(issue.select("issue_id", "project_id"), keys, "project_id")
    per_issue_user = (worklog.filter(F.col("user_id").isNotNull())
                      .groupBy("issue_id", "user_id").agg(F.sum("hours_logged").alias("h")))
    agg = (per_issue_user.join(issues, "issue_id", "inner")
           .groupBy("project_id", "user_id")
           .agg(hours_sum("h").alias("total_user_hours")))
    out = agg.join(user.select("user_id", "username"), "user_id", "inner").select(
        "project_id", "user_id", "username", "total_user_hours")
    if ordered:
        out = out.orderBy("project_id", F.desc("total_user_hours"), "user_id")
    return out


def user_issue_counts(user: DataFrame, issue: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """A4: ``(user_id, role, issue_count)`` with role in ('reporter', 'assignee').

    One scan of issues emits (user, role) pairs; a single grouped count follows.
    Every user (or every user in ``keys``) gets both roles, zero-filled.
    """
    user = restrict(user, keys, "user_id")
    pairs = issue.select(F.explode(F.array(
        F.struct(F.col("reporter_id").alias("user_id"), F.lit("reporter").alias("role")),
        F.struct(F.col("assignee_id").alias("user_id"), F.lit("assignee").alias("role")),
    )).alias("p")).select("p.user_id", "p.role").filter(F.col("user_id").isNotNull())
    counts = pairs.groupBy("user_id", "role").agg(F.count(F.lit(1)).alias("issue_count"))
    roles = user.select("user_id", F.explode(F.array(F.lit("reporter"), F.lit("assignee"))).alias("role"))
    return (roles.join(counts, ["user_id", "role"], "left")
            .select("user_id", "role", F.coalesce("issue_count", F.lit(0).cast("long")).alias("issue_count")))


def project_issue_counts(project: DataFrame, issue: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """A5: ``(project_id, issue_count)``, zero-filled (all projects or ``keys``)."""
    project = restrict(project, keys, "project_id")
    counts = issue.groupBy("project_id").agg(F.count(F.lit(1)).alias("issue_count"))
    return (project.select("project_id").join(counts, "project_id", "left")
            .select("project_id", F.coalesce("issue_count", F.lit(0).cast("long")).alias("issue_count")))


def issue_child_counts(issue: DataFrame, comment: DataFrame, worklog: DataFrame,
                       attachment: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Comments, worklogs and attachments per issue (uncapped), zero-filled
    (all issues or those in ``keys``).

    The three child tables are unioned into one narrow stream so a single
    aggregation (one shuffle) counts all three.
    """
    kinds = (comment.select("issue_id", F.lit(1).alias("c"), F.lit(0).alias("w"), F.lit(0).alias("a"))
             .unionByName(worklog.select("issue_id", F.lit(0).alias("c"), F.lit(1).alias("w"), F.lit(0).alias("a")))
             .unionByName(attachment.select("issue_id", F.lit(0).alias("c"), F.lit(0).alias("w"), F.lit(1).alias("a"))))
    counts = kinds.groupBy("issue_id").agg(
        F.sum("c").cast("long").alias("comment_count"),
        F.sum("w").cast("long").alias("worklog_count"),
        F.sum("a").cast("long").alias("attachment_count"))
    zero = F.lit(0).cast("long")
    return (restrict(issue.select("issue_id"), keys, "issue_id").join(counts, "issue_id", "left")
            .select("issue_id",
                    F.coalesce("comment_count", zero).alias("comment_count"),
                    F.coalesce("worklog_count", zero).alias("worklog_count"),
                    F.coalesce("attachment_count", zero).alias("attachment_count")))


def touch_events(comment: DataFrame, worklog: DataFrame, attachment: DataFrame) -> DataFrame:
    """Events that moved an issue's ``updated_date`` according to the stored rows.

    ``(issue_id, ts, kind)``: comment inserts and text edits (``updated_at`` is
    only set when the text changed), worklog inserts, attachment inserts.
    """
    return (comment.select("issue_id", F.col("created_at").alias("ts"), F.lit("comment_insert").alias("kind"))
            .unionByName(comment.filter(F.col("updated_at").isNotNull())
                         .select("issue_id", F.col("updated_at").alias("ts"), F.lit("comment_update").alias("kind")))
            .unionByName(worklog.select("issue_id", F.col("created_at").alias("ts"), F.lit("worklog_insert").alias("kind")))
            .unionByName(attachment.select("issue_id", F.col("uploaded_at").alias("ts"), F.lit("attachment_insert").alias("kind"))))


def last_touch(events: DataFrame) -> DataFrame:
    """``(issue_id, last_touch)``: newest touching event per issue (partial max)."""
    return (events.filter(F.col("kind").isin(*TOUCHING_KINDS) & F.col("ts").isNotNull())
            .groupBy("issue_id").agg(F.max("ts").alias("last_touch")))


def issue_last_activity(issue: DataFrame, events: DataFrame) -> DataFrame:
    """``(issue_id, last_activity)`` = greatest of ``updated_date`` and the
    newest touching event; ``greatest`` skips nulls."""
    return (issue.select("issue_id", "updated_date").join(last_touch(events), "issue_id", "left")
            .select("issue_id", F.greatest("updated_date", "last_touch").alias("last_activity")))


def hours_delta(totals: DataFrame, events: DataFrame) -> DataFrame:
    """New ``(issue_id, total_hours)`` from old totals and signed worklog events.

    Inserts add their hours, deletes subtract them, other kinds change nothing.
    Issues missing from ``totals`` start at 0.
    """
    sign = F.coalesce(*[F.when(F.col("kind") == k, F.lit(s)) for k, s in HOURS_SIGN.items()], F.lit(0))
    delta = (events.filter(F.col("kind").isin(*HOURS_SIGN))
             .groupBy("issue_id").agg(F.sum(F.col("hours") * sign).cast(HOURS_SUM).alias("delta")))
    return (totals.join(delta, "issue_id", "full")
            .select("issue_id",
                    (F.coalesce("total_hours", zero_hours()) + F.coalesce("delta", zero_hours()))
                    .cast(HOURS_SUM).alias("total_hours")))


def project_report(project: DataFrame, sprint: DataFrame, issue: DataFrame, worklog: DataFrame,
                   user: DataFrame) -> DataFrame:
    """The project page in long form — one row per (project, logging user).

    ``project_id, project_key, project_name, status, total_hours, issue_count,
    sprint_count, user_id, username, total_user_hours``. Projects without any
    user hours keep one row with null user columns. Worklogs are read and summed once, per
    (issue, user) with the null user kept, then per (project, user); the project totals (A2)
    and the user rows (A3) both come from those few rows.
    """
    per_issue_user = worklog.groupBy("issue_id", "user_id").agg(F.sum("hours_logged").alias("h"))
    per_user = (per_issue_user.join(issue.select("issue_id", "project_id"), "issue_id", "inner")
                .groupBy("project_id", "user_id").agg(F.sum("h").alias("h")))
    totals = per_user.groupBy("project_id").agg(hours_sum("h").alias("total_hours"))
    users = (per_user.filter(F.col("user_id").isNotNull()).join(user.select("user_id", "username"), "user_id", "inner")
             .select("project_id", "user_id", "username", F.col("h").cast(HOURS_SUM).alias("total_user_hours")))
    issues = issue.groupBy("project_id").agg(F.count(F.lit(1)).alias("issue_count"))
    sprints = sprint.groupBy("project_id").agg(F.count(F.lit(1)).alias("sprint_count"))
    out = project.select("project_id", "project_key", "project_name", "status")
    for figures in (totals, issues, sprints, users):
        out = out.join(figures, "project_id", "left")
    none = F.lit(0).cast("long")
    return out.select(
        "project_id", "project_key", "project_name", "status", F.coalesce("total_hours", zero_hours()).alias("total_hours"),
        F.coalesce("issue_count", none).alias("issue_count"), F.coalesce("sprint_count", none).alias("sprint_count"),
        "user_id", "username", "total_user_hours")
