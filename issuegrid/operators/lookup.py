"""F1–F8: key lookups, child filters, issue filter, backlog, EXISTS checks.

The reference answers these for one key per call; here the keys are a DataFrame
and each lookup is one semi-join for the whole batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup

# Case- and accent-insensitive comparison, the collation natural keys follow.
INSENSITIVE = "UNICODE_CI_AI"


def insensitive(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.collate(c, INSENSITIVE)


def lookup_by_keys(df: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    """rows of ``df`` whose primary key is in ``keys`` (first column or ``pk``).

    A left-semi join: each row of ``df`` appears once however often its key is
    repeated in ``keys``; AQE broadcasts ``keys`` only when it measures small.
    """
    k = keys.select(F.col(pk if pk in keys.columns else keys.columns[0]).alias(pk))
    return df.join(k, pk, "left_semi")


def lookup_by_natural_key(df: DataFrame, keys: DataFrame, column: str, key_column: str = "key") -> DataFrame:
    """rows of ``df`` whose ``column`` equals a key under the insensitive
    collation; output adds the ``key`` that matched. Keys are de-duplicated on
    the collated value first, so one row matches each distinct key once."""
    k = (keys.select(insensitive(key_column).alias("__ck"), F.col(key_column).alias("key"))
         .groupBy("__ck").agg(F.min("key").alias("key")))
    out = df.join(k, insensitive(df[column]) == k["__ck"], "inner")
    return out.drop("__ck")


def children_of(df: DataFrame, fk: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """rows of ``df`` whose ``fk`` is among ``parents[parent_key]`` (semi-join)."""
    p = parents.select(F.col(parent_key).alias(fk))
    return df.join(p, fk, "left_semi")


def issue_filter(issues: DataFrame, project_id: int | Column | None = None,
                 sprint_id: int | Column | None = None) -> DataFrame:
    """the sprint filter wins over the project filter; 0 counts as not given.
    Either may also be a Column (e.g. a scalar subquery).

    Raises ``ValueError`` when neither is given, as the listing endpoint refuses.
    """
    if isinstance(sprint_id, Column) or sprint_id:
        return issues.filter(F.col("sprint_id") == F.lit(sprint_id))
    if isinstance(project_id, Column) or project_id:
        return issues.filter(F.col("project_id") == F.lit(project_id))
    raise ValueError("either project_id or sprint_id must be given")


def not_equal(a: str | Column, b: str | Column) -> Column:
    """'value changed' where null → value and value → null also count."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return ~a.eqNullSafe(b)


def backlog(issues: DataFrame) -> DataFrame:
    """issues with no sprint."""
    return issues.filter(F.col("sprint_id").isNull())


def public_user_columns(users: DataFrame) -> DataFrame:
    """the only public view of users — never exposes ``password_hash``."""
    return users.drop("password_hash")


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """F8: an explicit column list (pruned down to the Parquet scan)."""
    return df.select(*columns)


def exists_checks(issue: DataFrame, project: DataFrame, sprint: DataFrame) -> DataFrame:
    """Per issue, the three EXISTS checks of issue creation.

    ``project_exists`` (one-column key), ``sprint_in_project`` and
    ``parent_in_project`` (two-column keys; true when no sprint / parent is set).
    Each check is a left join against the parents' primary keys — the plan Catalyst
    makes of a decorrelated EXISTS — with null keys spread (see ``lookup``).
    """
    p = project.select("project_id").withColumn("__has_project", F.lit(True))
    s = sprint.select("sprint_id", "project_id").withColumn("__has_sprint", F.lit(True))
    par = (issue.select(F.col("issue_id").alias("__pid"), F.col("project_id").alias("__ppid"))
           .withColumn("__has_parent", F.lit(True)))
    out = issue.select("issue_id", "project_id", "sprint_id", "parent_issue_id")
    out = lookup(out, p, "project_id", "project_id", {"__has_project": "__has_project"}, spread_by="issue_id")
    out = lookup(out, s, ["sprint_id", "project_id"], ["sprint_id", "project_id"], {"__has_sprint": "__has_sprint"}, spread_by="issue_id")
    out = lookup(out, par, ["parent_issue_id", "project_id"], ["__pid", "__ppid"], {"__has_parent": "__has_parent"}, spread_by="issue_id")
    return out.select(
        "issue_id",
        F.coalesce("__has_project", F.lit(False)).alias("project_exists"),
        (F.col("sprint_id").isNull() | F.coalesce("__has_sprint", F.lit(False))).alias("sprint_in_project"),
        (F.col("parent_issue_id").isNull() | F.coalesce("__has_parent", F.lit(False))).alias("parent_in_project"),
    )
