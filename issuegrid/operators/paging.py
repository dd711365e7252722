"""Ordered pages of one parent's children, and top-k per parent for all.

Every order ends with the primary key so pages are deterministic (the reference's
orders tie on timestamps). A single page plans as ``TakeOrderedAndProject``: each
task keeps its own top ``skip + limit`` rows and only those reach the final
merge. For deep pages use :func:`page_after` (keyset paging), which filters on the
last seen key instead of skipping rows. :func:`top_k_per_parent` pages every
parent at once with ``row_number``; Spark adds a partial ``WindowGroupLimit``
before the shuffle, so even a parent holding a third of all rows sends at most
``skip + limit`` rows per input partition to its task.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .enrich import attachment_enriched, comment_enriched, issue_enriched, project_enriched, worklog_enriched

DEFAULT_LIMIT = 100

# Fixed orders of the reference listings (column, descending?), PK appended.
# Null placement follows the reference database: nulls sort lowest, so first
# in ascending and last in descending order.
ORDERS: dict[str, list[tuple[str, bool]]] = {
    "users": [("user_id", False)],
    "projects": [("created_at", True), ("project_id", False)],
    "sprints": [("start_date", True), ("created_at", True), ("sprint_id", False)],
    "project_issues": [("created_date", True), ("issue_id", False)],
    "sprint_issues": [("priority", False), ("created_date", True), ("issue_id", False)],
    "comments": [("created_at", False), ("comment_id", False)],
    "worklogs": [("work_date", True), ("created_at", True), ("worklog_id", False)],
    "attachments": [("uploaded_at", True), ("attachment_id", False)],
}

# --- fixed values: priority rank for the optional "rank" order of P5 ----------
PRIORITY_RANK = {"Highest": 1, "High": 2, "Medium": 3, "Low": 4, "Lowest": 5}

#: Parts that a parent's rows are ranked in first when a page is deep.
SALTS = 64


def sort_columns(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first() for c, desc in order]


def page(df: DataFrame, order: list[tuple[str, bool]], skip: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page: ``ORDER BY order LIMIT limit OFFSET skip``."""
    if skip < 0 or limit < 0:
        raise ValueError("skip and limit must be >= 0")
    out = df.orderBy(*sort_columns(order))
    if skip:
        out = out.offset(skip)
    return out.limit(limit)


def page_after(df: DataFrame, order: list[tuple[str, bool]], last: dict | None,
               limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Keyset page: the ``limit`` rows that follow the row whose order values are
    ``last`` (None = first page). Cost does not grow with the page depth.

    Cursor values may be Python values or Columns (e.g. scalar subqueries).
    Nulls follow the page order: first in ascending, last in descending columns.
    """
    out = df
    if last is not None:
        def value(col: str) -> Column:
            v = last[col]
            return v if isinstance(v, Column) else F.lit(v)

        def after(col: str, desc: bool) -> Column:
            c, v = F.col(col), value(col)
            if desc:    # larger first, nulls last
                return (v.isNotNull() & c.isNull()) | F.coalesce(c < v, F.lit(False))
            return (v.isNull() & c.isNotNull()) | F.coalesce(c > v, F.lit(False))

        clauses = []
        for i, (col, desc) in enumerate(order):
            prefix = [F.col(c).eqNullSafe(value(c)) for c, _ in order[:i]]
            clauses.append(functools.reduce(lambda a, b: a & b, prefix + [after(col, desc)]))
        out = out.filter(functools.reduce(lambda a, b: a | b, clauses))
    return out.orderBy(*sort_columns(order)).limit(limit)


def cursor_of(df: DataFrame, order: list[tuple[str, bool]], position: int) -> dict[str, Column]:
    """The order values of the row at 1-based ``position`` as scalar subqueries —
    the cursor a client holds after reading that row."""
    row = df.orderBy(*sort_columns(order)).offset(position - 1).limit(1)
    return {c: row.select(c).scalar() for c, _ in order}


def top_k_per_parent(df: DataFrame, parent: str, order: list[tuple[str, bool]], skip: int = 0,
                     limit: int = DEFAULT_LIMIT, rank_col: str = "rn") -> DataFrame:
    """Rows ``skip+1 .. skip+limit`` of every parent, with their 1-based rank.

    Spark inserts the partial ``WindowGroupLimit`` (at most ``skip + limit`` rows
    per parent leave each map task) when ``skip + limit`` is within
    ``spark.sql.optimizer.windowGroupLimitThreshold``. For deeper pages the rows of a
    parent are first ranked in ``SALTS`` random parts, of which none keeps more than
    ``skip + limit`` rows, so no task holds all rows of a hot parent."""
    last = skip + limit
    if last > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, _ in order]), F.lit(SALTS)))
        part = Window.partitionBy(parent, "__salt").orderBy(*sort_columns(order))
        df = salted.withColumn(rank_col, F.row_number().over(part)).filter(F.col(rank_col) <= last).drop("__salt", rank_col)
    w = Window.partitionBy(parent).orderBy(*sort_columns(order))
    ranked = df.withColumn(rank_col, F.row_number().over(w))
    cond = F.col(rank_col) <= last
    if skip:
        cond = cond & (F.col(rank_col) > skip)
    return ranked.filter(cond)


def page_users(user: DataFrame, skip: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """P1 (public columns only)."""
    return page(user.drop("password_hash"), ORDERS["users"], skip, limit)


def page_projects(project: DataFrame, user: DataFrame, skip: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Projects (J1 columns), newest first. The owner join is LEFT, so the
    page is cut first and only its rows are enriched."""
    rows = page(project, ORDERS["projects"], skip, limit)
    return project_enriched(rows, user).orderBy(*sort_columns(ORDERS["projects"]))


def page_project_sprints(sprint: DataFrame, project_id: int, skip: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """P3."""
    return page(sprint.filter(F.col("project_id") == project_id), ORDERS["sprints"], skip, limit)


def _issue_page(issue, project, sprint, user, cond: Column, order, skip, limit,
                sort_exprs: list[Column] | None = None) -> DataFrame:
    # The listing's INNER join to projects is applied as a semi-join before
    # paging; the remaining joins are LEFT and cannot change which rows make
    # the page, so only the page's rows are enriched.
    base = issue.filter(cond).join(project.select("project_id"), "project_id", "left_semi")
    rows = issue_enriched(page(base, order, skip, limit), project, sprint, user)
    return rows.orderBy(*(sort_exprs or sort_columns(order)))


def page_project_issues(issue, project, sprint, user, project_id: int, skip: int = 0,
                        limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Enriched issues of a project, newest first."""
    return _issue_page(issue, project, sprint, user, F.col("project_id") == project_id,
                       ORDERS["project_issues"], skip, limit)


def priority_rank(col: str = "priority") -> Column:
    """Rank of a priority name (Highest = 1 … Lowest = 5); unknown names last."""
    m = F.create_map(*[x for k, v in PRIORITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(col)], F.lit(len(PRIORITY_RANK) + 1))


def page_sprint_issues(issue, project, sprint, user, sprint_id: int, skip: int = 0,
                       limit: int = DEFAULT_LIMIT, order: str = "alphabetical") -> DataFrame:
    """P5: enriched issues of a sprint. ``order="alphabetical"`` (the reference:
    High, Highest, Low, Lowest, Medium) or ``"rank"`` (Highest … Lowest)."""
    cond = F.col("sprint_id") == sprint_id
    if order != "rank":
        return _issue_page(issue, project, sprint, user, cond, ORDERS["sprint_issues"], skip, limit)
    rest = ORDERS["sprint_issues"][1:]
    ranked = issue.withColumn("__prio", priority_rank())
    page_rows = page(ranked.filter(cond).join(project.select("project_id"), "project_id", "left_semi"),
                     [("__prio", False)] + rest, skip, limit)
    out = issue_enriched(page_rows, project, sprint, user)
    return out.orderBy(priority_rank().asc(), *sort_columns(rest))


def page_issue_comments(comment: DataFrame, user: DataFrame, issue_id: int, skip: int = 0,
                        limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Comments of an issue (J4 columns), oldest first."""
    rows = page(comment.filter(F.col("issue_id") == issue_id), ORDERS["comments"], skip, limit)
    return comment_enriched(rows, user).orderBy(*sort_columns(ORDERS["comments"]))


def page_issue_worklogs(worklog: DataFrame, user: DataFrame, issue_id: int, skip: int = 0,
                        limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Worklogs of an issue (J3 columns), latest work date first."""
    rows = page(worklog.filter(F.col("issue_id") == issue_id), ORDERS["worklogs"], skip, limit)
    return worklog_enriched(rows, user).orderBy(*sort_columns(ORDERS["worklogs"]))


def page_issue_attachments(attachment: DataFrame, user: DataFrame, issue_id: int, skip: int = 0,
                           limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Attachments of an issue (J5 columns), newest first."""
    rows = page(attachment.filter(F.col("issue_id") == issue_id), ORDERS["attachments"], skip, limit)
    return attachment_enriched(rows, user).orderBy(*sort_columns(ORDERS["attachments"]))
