"""Registered queries for validity checks."""

from __future__ import annotations

from ..operators import quality
from .catalog import query


def _report(table):
    def fn(t):
        return quality.validation_report(t[table], table)
    fn.__doc__ = f"V1–V9: every {table} row with is_valid and its broken rules."
    return fn


for _table in ("worklog", "issue", "project", "user", "sprint", "comment", "attachment"):
    query(f"validate_{_table}")(_report(_table))


@query("fk_violations")
def fk_violations(t):
    """Foreign keys without a parent row, over all thirteen keys."""
    return quality.fk_violations(t)


@query("duplicate_keys")
def duplicate_keys(t):
    """Repeated usernames, emails, project keys, file paths (insensitive)."""
    return quality.duplicate_keys(t)


@query("sprint_project_mismatch")
def sprint_project_mismatch(t):
    """Sprint requests the issue trigger refuses (sprint of another project)."""
    return quality.sprint_project_mismatch(t["issue"], t["sprint"], t["sprint_request"])


@query("parent_project_mismatch")
def parent_project_mismatch(t):
    """Issues whose parent is not in the same project."""
    return quality.parent_project_mismatch(t["issue"])


@query("violation_counts")
def violation_counts(t):
    """Violations per table and rule over every check."""
    return quality.violation_counts({k: t[k] for k in ("user", "project", "sprint", "issue", "comment",
                                                       "attachment", "worklog")})


# The same checks over tables with bad rows of every kind (stand-in views t_dirty_*).
DIRTY = ("user", "project", "sprint", "issue", "comment", "attachment", "worklog")


def _dirty(t):
    return {k: t[f"dirty_{k}"] for k in DIRTY}


def _dirty_report(table):
    def fn(t):
        return quality.validation_report(t[f"dirty_{table}"], table)
    fn.__doc__ = f"V1–V9 over {table} rows of which some break each rule."
    return fn


for _table in DIRTY:
    query(f"validate_dirty_{_table}")(_dirty_report(_table))


@query("dirty_fk_violations")
def dirty_fk_violations(t):
    """V11 over tables with dangling keys."""
    return quality.fk_violations(_dirty(t))


@query("dirty_duplicate_keys")
def dirty_duplicate_keys(t):
    """V10 over tables with repeated natural keys, also in other letter case."""
    return quality.duplicate_keys(_dirty(t))


@query("dirty_violation_counts")
def dirty_violation_counts(t):
    """Violations per table and rule over tables with bad rows."""
    return quality.violation_counts(_dirty(t))


@query("project_missing")
def project_missing(t):
    """New issues whose project does not exist."""
    return quality.project_missing(t["new_issue"], t["project"], "request_id")
