"""Dataset validity checks.

The reference rejects one request at a time; here a whole DataFrame is split into
valid rows and rejected rows carrying ``reasons: array<string>``. Row-local rules
are one projection (no shuffle). Key rules are joins: unknown parents are
``left_anti`` joins per foreign key, duplicates one aggregation on the collated key.
Reason codes have the form ``<column>:<problem>``, listed in rule order.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ENUMS, FOREIGN_KEYS, LENGTHS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS, not_null_columns
from .lookup import insensitive

# --- fixed values: patterns and bounds of the request models ------------------
PROJECT_KEY_PATTERN = r"^[A-Z0-9]{1,10}\z"   # \z: Java's $ would accept a final newline
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"
MAX_HOURS = "999.99"


def row_rules(table: str, columns: list[str]) -> list[tuple[str, Column]]:
    """``(reason, broken)`` pairs for the row-local rules of ``table`` whose
    columns are present in ``columns``."""
    have = set(columns)
    rules: list[tuple[str, Column]] = []
    for c in not_null_columns(table):                                  # V9
        if c in have:
            rules.append((f"{c}:missing", F.col(c).isNull()))
    for (t, c), values in ENUMS.items():                               # V1
        if t == table and c in have:
            rules.append((f"{c}:not_allowed", ~F.col(c).isin(*values)))
    for (t, c), (lo, hi) in LENGTHS.items():                           # V4, V5, V7, V8
        if t == table and c in have:
            if lo is not None:
                rules.append((f"{c}:too_short", F.length(c) < lo))
            if hi is not None:
                rules.append((f"{c}:too_long", F.length(c) > hi))
    if table == "project" and "project_key" in have:                   # V3
        rules.append(("project_key:bad_pattern", ~F.col("project_key").rlike(PROJECT_KEY_PATTERN)))
    if table == "user" and "email" in have:                            # V7
        rules.append(("email:bad_shape", ~F.col("email").rlike(EMAIL_PATTERN)))
    if table == "worklog" and "hours_logged" in have:                  # V2
        h = F.col("hours_logged")
        rules += [("hours_logged:not_positive", h <= 0),
                  ("hours_logged:rounds_to_zero", (h > 0) & (F.bround(h, 2) <= 0)),
                  ("hours_logged:too_large", h > F.lit(MAX_HOURS).cast("decimal(5,2)"))]
    if table == "issue" and "story_points" in have:                    # V6
        rules.append(("story_points:negative", F.col("story_points") < 0))
    if table == "attachment" and "file_size_bytes" in have:
        rules.append(("file_size_bytes:negative", F.col("file_size_bytes") < 0))
    return rules


def with_reasons(df: DataFrame, table: str, reasons_col: str = "reasons") -> DataFrame:
    """``df`` plus ``reasons`` (array of broken rule codes, empty when valid)."""
    rules = row_rules(table, df.columns)
    arr = F.array(*[F.when(broken, F.lit(code)) for code, broken in rules]) if rules else F.array()
    return df.withColumn(reasons_col, F.array_compact(arr).cast("array<string>"))


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Split into ``(ok, bad)``; ``bad`` keeps a ``reasons`` column. Every input row
    lands in exactly one side."""
    marked = with_reasons(df, table)
    ok = marked.filter(F.size("reasons") == 0).drop("reasons")
    bad = marked.filter(F.size("reasons") > 0)
    return ok, bad


def validation_report(df: DataFrame, table: str) -> DataFrame:
    """``(<pk>, is_valid, reasons)`` for every row, reasons joined with ','."""
    pk = PRIMARY_KEYS[table]
    marked = with_reasons(df, table)
    return marked.select(pk, (F.size("reasons") == 0).alias("is_valid"),
                         F.array_join("reasons", ",").alias("reasons"))


def _with_parent_flags(tables: dict[str, DataFrame], table: str, df: DataFrame) -> tuple[DataFrame, list]:
    """Left-join ``df`` (rows of ``table``) once per foreign key against the
    parent's primary key (unique, so no row is repeated). Adds ``__has_<fk>`` (true when the parent exists)
    and, for an issue's sprint and parent, ``__proj_<fk>`` (the parent's
    project). Null keys are spread (see ``lookup``). Returns the frame and the
    foreign keys checked."""
    from .common import lookup

    pk = PRIMARY_KEYS[table]
    checked = []
    for fk in FOREIGN_KEYS:
        if fk.child != table or fk.parent not in tables or fk.column not in df.columns:
            continue
        flag, proj = f"__has_{fk.column}", f"__proj_{fk.column}"
        if table == "issue" and fk.column in SAME_PROJECT_KEYS:
            parent = (tables[fk.parent].select(F.col(fk.parent_key).alias("__k"), F.col("project_id").alias(proj)))
            cols = {flag: flag, proj: proj}
        else:
            parent = tables[fk.parent].select(F.col(fk.parent_key).alias("__k"))
            cols = {flag: flag}
        df = lookup(df, parent.withColumn(flag, F.lit(True)), fk.column, "__k", cols, spread_by=pk)
        checked.append(fk)
    return df, checked


SAME_PROJECT_KEYS = ("sprint_id", "parent_issue_id")


def fk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """``(child_table, fk_column, child_id, missing_key)`` for every non-null
    foreign key without a parent row. Each child table is scanned once; its
    keys are checked by one left join each."""
    parts = []
    for table in SCHEMAS:
        if table not in tables:
            continue
        pk = PRIMARY_KEYS[table]
        df, fks = _with_parent_flags(tables, table, tables[table])
        if not fks:
            continue
        found = F.array_compact(F.array(*[
            F.when(F.col(fk.column).isNotNull() & F.col(f"__has_{fk.column}").isNull(),
                   F.struct(F.lit(fk.column).alias("fk_column"), F.col(fk.column).cast("long").alias("missing_key")))
            for fk in fks]))
        parts.append(df.select(F.lit(table).alias("child_table"), F.col(pk).cast("long").alias("child_id"),
                               F.explode(found).alias("v"))
                     .select("child_table", "v.fk_column", "child_id", "v.missing_key"))
    return functools.reduce(DataFrame.unionByName, parts)


def duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose natural key repeats an earlier row's under the case- and
    accent-insensitive collation. The lowest primary key wins; the others are
    reported as ``(table_name, column_name, row_id, value, kept_id)``.

    One aggregation per key finds the winner and the group size (partial
    aggregation, so a hot key costs one partial row per task); only groups with
    more than one row are joined back."""
    parts = []
    for table, column in UNIQUE_KEYS:
        if table not in tables or column not in tables[table].columns:
            continue
        pk = PRIMARY_KEYS[table]
        rows = tables[table].select(F.col(pk).cast("long").alias("row_id"), F.col(column).alias("value"),
                                    insensitive(column).alias("__ck"))
        groups = (rows.filter(F.col("__ck").isNotNull()).groupBy("__ck")
                  .agg(F.min("row_id").alias("kept_id"), F.count(F.lit(1)).alias("__n"))
                  .filter(F.col("__n") > 1))
        dups = rows.join(groups, "__ck", "inner").filter(F.col("row_id") != F.col("kept_id"))
        parts.append(dups.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                                 "row_id", "value", "kept_id"))
    return functools.reduce(DataFrame.unionByName, parts)


def sprint_project_mismatch(issue: DataFrame, sprint: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """A sprint set on an issue belongs to another project.

    Without ``proposed``: issues in the table whose sprint is in another project.
    With ``proposed`` (``request_id, issue_id, sprint_id``): the changes the issue
    trigger refuses — the sprint changes to a non-null value and that sprint
    exists in a project other than the issue's. (A sprint that does not exist is
    not this rule's finding; it fails the key check.)"""
    sp = sprint.select("sprint_id", F.col("project_id").alias("sprint_project_id"))
    if proposed is None:
        cur = issue.filter(F.col("sprint_id").isNotNull()).select("issue_id", "sprint_id", "project_id")
        return (cur.join(sp, "sprint_id", "inner")
                .filter(F.col("sprint_project_id") != F.col("project_id"))
                .select("issue_id", "sprint_id", F.col("project_id").alias("issue_project_id"), "sprint_project_id"))
    cur = issue.select("issue_id", F.col("sprint_id").alias("old_sprint_id"), F.col("project_id").alias("issue_project_id"))
    req = (proposed.filter(F.col("sprint_id").isNotNull())
           .join(cur, "issue_id", "inner")
           .filter(~F.col("old_sprint_id").eqNullSafe(F.col("sprint_id"))))
    return (req.join(sp, "sprint_id", "inner")
            .filter(F.col("sprint_project_id") != F.col("issue_project_id"))
            .select("request_id", "issue_id", "sprint_id", "issue_project_id", "sprint_project_id"))


def parent_project_mismatch(issue: DataFrame) -> DataFrame:
    """Issues whose parent is not an issue of the same project (the create
    rule: NOT EXISTS parent with the same project, so a missing parent counts).
    ``(issue_id, parent_issue_id, project_id)``."""
    child = issue.filter(F.col("parent_issue_id").isNotNull()).select("issue_id", "parent_issue_id", "project_id")
    parents = issue.select(F.col("issue_id").alias("parent_issue_id"), "project_id")
    return child.join(parents, ["parent_issue_id", "project_id"], "left_anti").select(
        "issue_id", "parent_issue_id", "project_id")


def project_missing(rows: DataFrame, project: DataFrame, id_col: str) -> DataFrame:
    """Rows (new issues or sprints) whose ``project_id`` does not exist."""
    return rows.join(project.select("project_id"), "project_id", "left_anti").select(id_col, "project_id")


def checked_table(tables: dict[str, DataFrame], table: str) -> DataFrame:
    """One pass over ``table``: its row-rule reasons plus key reasons —
    ``<fk>:unknown_parent`` for every foreign key without a parent row, and for
    issues ``sprint_id:other_project`` (V12: the sprint exists in another
    project) and ``parent_issue_id:other_project`` (V13: no parent issue in the
    same project). The table is scanned once however many keys it has."""
    df, fks = _with_parent_flags(tables, table, with_reasons(tables[table], table))
    extra = []
    for fk in fks:
        flag, proj = F.col(f"__has_{fk.column}"), F.col(f"__proj_{fk.column}")
        extra.append(F.when(F.col(fk.column).isNotNull() & flag.isNull(), F.lit(f"{fk.column}:unknown_parent")))
        if table == "issue" and fk.column == "sprint_id":
            extra.append(F.when(flag & (proj != F.col("project_id")), F.lit("sprint_id:other_project")))
        elif table == "issue" and fk.column == "parent_issue_id":
            extra.append(F.when(F.col(fk.column).isNotNull() & ~F.coalesce(proj == F.col("project_id"), F.lit(False)),
                                F.lit("parent_issue_id:other_project")))
    if extra:
        df = df.withColumn("reasons", F.concat("reasons", F.array_compact(F.array(*extra))))
    return df.drop(*[c for c in df.columns if c.startswith("__has_") or c.startswith("__proj_")])


def violation_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, reason, violations)`` over every rule: row rules of each
    table, unknown foreign keys, sprint and parent in another project (all in
    one pass per table, :func:`checked_table`) and duplicate natural keys."""
    parts = []
    for table in SCHEMAS:
        if table in tables:
            parts.append(checked_table(tables, table).select(F.lit(table).alias("table_name"),
                                                             F.explode("reasons").alias("reason")))
    parts.append(duplicate_keys(tables).select("table_name",
                                               F.concat(F.col("column_name"), F.lit(":duplicate")).alias("reason")))
    union = functools.reduce(DataFrame.unionByName, parts)
    return union.groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("violations"))
