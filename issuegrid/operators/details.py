"""The issue document — enriched issue + its first comments, worklogs and
attachments + total hours over all worklogs, for every requested issue at once.

Plan: each child list is cut to its first ``limit`` rows per issue with
``row_number`` (Spark inserts a partial ``WindowGroupLimit`` before the shuffle),
enriched with usernames, then collected per issue and sorted by rank. The lists
are therefore bounded by ``limit`` however busy an issue is. The three lists are
aggregated separately and joined to the issue one row per issue, so they never
multiply each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hours_sum, restrict, zero_hours
from .enrich import attachment_enriched, comment_enriched, issue_enriched, worklog_enriched
from .paging import DEFAULT_LIMIT, ORDERS, top_k_per_parent

CHILD_FIELDS = {
    "comments": ["comment_id", "user_id", "author_username", "comment_text", "created_at", "updated_at"],
    "worklogs": ["worklog_id", "user_id", "logger_username", "hours_logged", "work_date", "description",
                 "created_at"],
    "attachments": ["attachment_id", "user_id", "uploader_username", "file_name", "file_path", "file_type",
                    "file_size_bytes", "uploaded_at"],
}
CHILD_KEYS = {"comments": "comment_id", "worklogs": "worklog_id", "attachments": "attachment_id"}
CHILD_USER = {"comments": "author_username", "worklogs": "logger_username", "attachments": "uploader_username"}
ENRICH = {"comments": comment_enriched, "worklogs": worklog_enriched, "attachments": attachment_enriched}


def _child_list(df: DataFrame, kind: str, limit: int, user: DataFrame) -> DataFrame:
    # Cut to the first ``limit`` per issue first, then look up usernames for
    # the surviving rows only.
    top = top_k_per_parent(df, "issue_id", ORDERS[kind], 0, limit, rank_col="__rn")
    top = ENRICH[kind](top, user)
    fields = [f for f in CHILD_FIELDS[kind] if f in top.columns]
    lists = top.groupBy("issue_id").agg(F.collect_list(F.struct("__rn", *fields)).alias("__l"))
    return lists.select("issue_id", F.transform(
        F.array_sort("__l"), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(kind))


def issue_details(issue: DataFrame, project: DataFrame, sprint: DataFrame, user: DataFrame,
                  comment: DataFrame, worklog: DataFrame, attachment: DataFrame,
                  keys: DataFrame | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One document row per issue (all issues, or those in ``keys``)."""
    issues = restrict(issue, keys, "issue_id")
    children = {"comments": comment, "worklogs": worklog, "attachments": attachment}
    if keys is not None:
        ids = issues.select("issue_id")
        children = {k: df.join(ids, "issue_id", "left_semi") for k, df in children.items()}
    # A1 over all of each issue's worklogs, joined straight to the document
    # (zero when the issue has none).
    hours = (children["worklogs"].groupBy("issue_id")
             .agg(hours_sum("hours_logged").alias("total_hours")))
    doc = (issue_enriched(issues, project, sprint, user).join(hours, "issue_id", "left")
           .withColumn("total_hours", F.coalesce("total_hours", zero_hours())))
    for kind, df in children.items():
        lst = _child_list(df, kind, limit, user)
        doc = doc.join(lst, "issue_id", "left")
        elem = lst.schema[kind].dataType
        doc = doc.withColumn(kind, F.coalesce(F.col(kind), F.array().cast(elem)))
    return doc


def _tagger(kind: str):
    def tag(e, i):
        return F.struct(F.lit(kind).alias("kind"), i.alias("pos"), e[CHILD_KEYS[kind]].cast("long").alias("child_id"),
                        e[CHILD_USER[kind]].alias("child_user"))
    return tag


def explode_details(doc: DataFrame) -> DataFrame:
    """Flat form of :func:`issue_details` for comparison and export:
    ``(issue_id, project_key, status, total_hours, kind, pos, child_id, child_user)``,
    one row per list entry (0-based ``pos``) and one null row for an empty list.
    The three lists are tagged and concatenated per row, then exploded once, so
    the document is computed a single time."""
    head = ["issue_id", "project_key", "status", "total_hours"]
    tagged = []
    for kind in CHILD_FIELDS:
        entries = F.transform(F.col(kind), _tagger(kind))
        empty = F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("pos"),
                                 F.lit(None).cast("long").alias("child_id"),
                                 F.lit(None).cast("string").alias("child_user")))
        tagged.append(F.when(F.size(kind) == 0, empty).otherwise(entries))
    return (doc.select(*head, F.explode(F.concat(*tagged)).alias("x"))
            .select(*head, "x.kind", "x.pos", "x.child_id", "x.child_user"))
