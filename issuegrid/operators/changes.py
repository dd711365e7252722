"""Set-based inserts, updates and deletes over snapshot tables.

Plain Parquet has no MERGE, so every change is a pure function
``(tables, changes, now) -> new DataFrames`` that the caller writes to a new
directory (:func:`issuegrid.sources.tables.save_tables`). ``now`` is a parameter
(not the clock), so a batch replays identically.

Several changes to the same row in one batch are applied in ``change_id`` order,
exactly as if sent one by one: a rejected change alters nothing, and the
outcome per row and field is the last accepted change. Each "last change" is a
``max(struct(change_id, value))`` aggregate — partial aggregation keeps a hot
row (one issue receiving a third of all changes) from landing in one task.
"""

from __future__ import annotations

import functools
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import (AUTO_UPDATE_COLUMNS, CASCADE_ORDER, COLUMN_DEFAULTS, FOREIGN_KEYS, INSERT_DEFAULTS, ISSUE_STATUSES,
                      PATCH_ALLOW, PRIMARY_KEYS, SCHEMAS, TOUCHING_KINDS, UNIQUE_KEYS)
from ..session import checkpoint_dir
from .claims import ROUNDS, claims_of, codes, one_by_one
from .common import lookup
from .lookup import insensitive, not_equal
from .quality import SAME_PROJECT_KEYS, row_rules
from .sequence import next_start

DEFAULT_NOW = "2025-01-01 00:00:00"

# --- fixed values: rejection messages -----------------------------------------
SPRINT_REJECTED = "Target sprint does not exist or belongs to a different project."
ISSUE_NOT_FOUND = "Issue not found"


def _now(now: str | Column | None) -> Column:
    if isinstance(now, Column):
        return now
    return F.lit(now or DEFAULT_NOW).cast("timestamp")


def _or(cols: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


# ---------------------------------------------------------------- D2 assign_ids

def assign_ids(df: DataFrame, id_col: str, order_by: list[str], start_after: Column | int = 0) -> DataFrame:
    """Dense BIGINT ids ``start_after + 1 … start_after + n`` in ``order_by`` order.

    Equal to ``start_after + row_number() OVER (ORDER BY order_by)`` without the
    single-task window. The rows are range-partitioned, sorted and written **once** to
    the shared checkpoint folder together with their partition and position
    (``monotonically_increasing_id``); the per-partition counts and the rows are both
    taken from that copy, so the counts belong to the rows however the range bounds
    were drawn, and a lost executor cannot renumber them. A prefix sum over the counts
    (one row per partition, the only broadcast) gives each partition's offset.
    ``order_by`` must be a total order (end with a unique column).
    """
    checkpoint_dir(df.sparkSession)
    rows = df.orderBy(*order_by).withColumn("__mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    rows = (rows.withColumn("__part", F.shiftright("__mid", 33))
            .withColumn("__local", F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    base = start_after if isinstance(start_after, Column) else F.lit(start_after)
    return (rows.join(F.broadcast(offsets), "__part")
            .withColumn(id_col, (base + F.col("__off") + F.col("__local") + 1).cast("long"))
            .drop("__mid", "__part", "__local", "__off"))


def max_id(df: DataFrame, id_col: str) -> Column:
    """Largest existing id (0 for an empty table) as a scalar subquery column."""
    return F.coalesce(df.select(F.max(id_col)).scalar(), F.lit(0))


# ---------------------------------------------------------------- D1 insert_rows

RAW_HOURS = "decimal(20,6)"   # hours as sent, before they are rounded and narrowed
ACTING_USER_COLUMN = {"project": "owner_id", "issue": "reporter_id", "comment": "user_id",
                      "worklog": "user_id", "attachment": "user_id"}
CREATED_COLUMN = {"user": "created_at", "project": "created_at", "sprint": "created_at",
                  "issue": "created_date", "comment": "created_at", "worklog": "created_at",
                  "attachment": "uploaded_at"}


def shaped(table: str, requests: DataFrame, now: Column, acting_user: str | None = None) -> list[tuple[T.StructField, Column]]:
    """The columns of new rows made of insert requests: forced values, then the acting user,
    the creation instant, the request's value or the default (hours as sent)."""
    forced = INSERT_DEFAULTS.get(table, {})
    defaults = COLUMN_DEFAULTS.get(table, {})
    cols = []
    for f in SCHEMAS[table].fields:
        if f.name in forced:
            c = F.lit(forced[f.name]).cast(f.dataType)
        elif acting_user and f.name == ACTING_USER_COLUMN.get(table):
            c = F.col(acting_user).cast(f.dataType)
        elif f.name == CREATED_COLUMN.get(table):
            c = now
        elif f.name in requests.columns:
            c = F.col(f.name).cast(RAW_HOURS if f.name == "hours_logged" else f.dataType)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        elif f.name in defaults:
            c = F.lit(defaults[f.name]).cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append((f, c))
    return cols


def insert_rows(table: str, requests: DataFrame, tables: dict[str, DataFrame], now: str | Column | None = None,
                request_key: str = "request_id", acting_user: str | None = None,
                assign: bool = True, sequences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Turn insert requests into new rows of ``table``.

    Forced values win over the request (issue status 'To Do'; project status
    'planning' with start/end dates dropped; user role 'user'); columns the
    request leaves null take the table defaults; the acting user becomes the
    reporter / owner / author when ``acting_user`` names its column. Each row is
    checked against the row rules (§ validity), its foreign keys must resolve
    (the database's unknown-parent error) and its unique keys must be free (D10).
    Accepted rows get ids after the table's largest id - or, with ``sequences``
    (:mod:`.sequence`), after the last one ever given out - in ``request_key`` order (D2). An issue's sprint and parent must be in its project (V12, V13). Hours are
    tested as sent; an accepted value is then rounded half-even to two places (X10).

    Returns ``(accepted, rejected)``; ``rejected`` = requests + ``reasons``.
    """
    schema = SCHEMAS[table]
    pk = PRIMARY_KEYS[table]
    cols = [c.alias(f.name) for f, c in shaped(table, requests, _now(now), acting_user) if f.name != pk]
    rows = requests.select(F.col(request_key), *cols)
    rules = [(code, broken) for code, broken in row_rules(table, rows.columns) if not code.startswith(f"{pk}:")]
    checked = rows.withColumn("reasons", F.array_compact(F.array(*[F.when(b, F.lit(c)) for c, b in rules])))
    # Foreign keys must resolve: one left join per key against the parent's ids (and, for an
    # issue's sprint and parent, their project).
    for fk in FOREIGN_KEYS:
        if fk.child != table or fk.parent not in tables:
            continue
        same = table == "issue" and fk.column in SAME_PROJECT_KEYS
        parent = tables[fk.parent].select(F.col(fk.parent_key).alias("__k"), F.lit(True).alias("__hit"),
                                          (F.col("project_id") if same else F.lit(None).cast("int")).alias("__proj"))
        given = F.col(fk.column).isNotNull()
        missing = F.when(given & F.col("__hit").isNull(), F.lit(f"{fk.column}:unknown_parent"))
        other = F.when(given & (F.col("__proj") != F.col("project_id")), F.lit(f"{fk.column}:other_project"))
        checked = (lookup(checked, parent, fk.column, "__k", {"__hit": "__hit", "__proj": "__proj"}, spread_by=request_key)
                   .withColumn("reasons", F.concat("reasons", F.array_compact(F.array(missing, *([other] if same else [])))))
                   .drop("__hit", "__proj"))
    if table in tables and any(t == table for t, _ in UNIQUE_KEYS):
        # Unique keys (insensitive) must be free in the table and not
        # claimed by an earlier request that passes every other rule.
        passing = checked.filter(F.size("reasons") == 0)
        dup = (reject_duplicates(table, tables[table], passing, request_key)
               .filter(~F.col("accepted")).select(request_key, F.col("reasons").alias("__dup")))
        checked = (checked.join(dup, request_key, "left")
                   .withColumn("reasons", F.when(F.col("__dup").isNotNull(), F.concat("reasons", "__dup"))
                               .otherwise(F.col("reasons")))
                   .drop("__dup"))
    accepted = checked.filter(F.size("reasons") == 0).drop("reasons")
    if "hours_logged" in accepted.columns:                             # X10, then the stored width
        accepted = accepted.withColumn("hours_logged", F.bround("hours_logged", 2).cast(schema["hours_logged"].dataType))
    rejected = checked.filter(F.size("reasons") > 0)
    if assign:
        start = max_id(tables[table], pk) if table in tables else F.lit(0)
        if sequences is not None:
            start = F.greatest(start, next_start(sequences, table))
        accepted = assign_ids(accepted, pk, [request_key], start)
    return accepted, rejected


# ---------------------------------------------------------------- D8 auto_touch

def auto_touch(old: DataFrame, new: DataFrame, table: str, now: str | Column | None = None) -> DataFrame:
    """In ``new`` (same keys as ``old``), move the table's last-changed column
    to ``now`` on rows where some other column really changed (null-safe), and
    keep the old instant elsewhere."""
    pk = PRIMARY_KEYS[table]
    auto = AUTO_UPDATE_COLUMNS[table]
    compare = [c for c in new.columns if c not in (pk, auto) and c in old.columns]
    o = old.select(pk, *[F.col(c).alias(f"__old_{c}") for c in compare + [auto]])
    joined = new.join(o, pk, "left")
    changed = _or([not_equal(c, f"__old_{c}") for c in compare])
    out = joined.withColumn(auto, F.when(changed, _now(now)).otherwise(F.col(f"__old_{auto}")))
    return out.drop(*[f"__old_{c}" for c in compare + [auto]])


# ---------------------------------------------------------------- D3 apply_patches

def apply_patches(table: str, df: DataFrame, patches: DataFrame, now: str | Column | None = None,
                  change_key: str = "change_id", parents: dict[str, DataFrame] | None = None,
                  whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """D3: general updates. A patch row carries ``pk``, ``set_fields`` and one
    column per field. Only fields named in ``set_fields`` change — a field set to
    null becomes null, an absent field keeps its value — and fields outside the
    table's allow-list are ignored. A patch that would break a row rule (e.g. an
    unknown priority) is rejected whole, as is a patch for an unknown row or one that
    sets a foreign key to a row that does not exist (``parents``: the parent tables;
    the table itself is always known). Rows that some accepted patch really changed on
    the way, even if a later one changed them back, get ``now`` as last-changed
    instant (D8). Without ``whole``, ``df`` holds only some columns of its table: patches are
    judged by all fields, as for the whole table, and applied to the columns that are there.

    Plan: valid patches are reduced to one row per key (per field the last setter, the
    smallest and the largest value and whether a null was set; all partial aggregates),
    joined once to the table; the D8 test compares them with the old values in the
    same projection.

    Returns ``(new_table, rejected_patches)``.
    """
    pk = PRIMARY_KEYS[table]
    allowed = [f for f in PATCH_ALLOW[table] if f in patches.columns and (f in df.columns or not whole)]
    types = {f.name: f.dataType for f in SCHEMAS[table].fields}
    probe = patches.select(F.col(change_key), F.col("pk"), "set_fields",
                           *[F.col(f).cast(RAW_HOURS if f == "hours_logged" else types[f]).alias(f) for f in allowed])
    checks = [F.when(F.array_contains("set_fields", code.split(":")[0]) & broken, F.lit(code))
              for code, broken in row_rules(table, allowed)]
    probe = probe.withColumn("reasons", F.array_compact(F.array(*checks)) if checks
                             else F.array().cast("array<string>"))
    known = {**(parents or {}), table: df}
    for fk in FOREIGN_KEYS:
        if fk.child != table or fk.column not in allowed or fk.parent not in known:
            continue
        keys = known[fk.parent].select(F.col(fk.parent_key).alias("__k"), F.lit(True).alias("__hit"))
        bad = F.array_contains("set_fields", fk.column) & F.col(fk.column).isNotNull() & F.col("__hit").isNull()
        probe = (lookup(probe, keys, fk.column, "__k", {"__hit": "__hit"}, spread_by=change_key)
                 .withColumn("reasons", F.when(bad, F.concat("reasons", F.array(F.lit(f"{fk.column}:unknown_parent"))))
                             .otherwise(F.col("reasons"))).drop("__hit"))
    probe = _unique_conflicts(table, df, probe, allowed, change_key)
    good = probe.filter(F.size("reasons") == 0)
    unknown = (good.join(df.select(F.col(pk).alias("pk")), "pk", "left_anti")
               .withColumn("reasons", F.array(F.lit(f"{pk}:not_found"))))
    rejected = probe.filter(F.size("reasons") > 0).unionByName(unknown)
    if "hours_logged" in allowed:                                      # X10, then the stored width
        sent = F.when(F.array_contains("set_fields", "hours_logged"), F.bround("hours_logged", 2))   # others are untested
        good = good.withColumn("hours_logged", sent.cast(types["hours_logged"]))
    here = [f for f in allowed if f in df.columns]
    if here != allowed and AUTO_UPDATE_COLUMNS.get(table) in df.columns:
        raise ValueError(f"{table}: its last-changed instant needs every patched column")
    allowed, per_field = here, []
    for f in allowed:
        sets, v = F.array_contains("set_fields", f), F.col(f)
        per_field += [F.max(F.when(sets, F.struct(F.col(change_key).alias("k"), v.alias("v")))).alias(f"__set_{f}"),
                      F.min(F.when(sets, v)).alias(f"__lo_{f}"), F.max(F.when(sets, v)).alias(f"__hi_{f}"),
                      F.max(F.when(sets & v.isNull(), 1)).alias(f"__nul_{f}")]
    last = good.groupBy("pk").agg(*per_field)
    joined = df.join(last.withColumnRenamed("pk", pk), pk, "left")
    moved = lambda f: F.when(F.col(f).isNull(), F.col(f"__hi_{f}").isNotNull()).otherwise(
        F.col(f"__nul_{f}").isNotNull() | (F.col(f"__lo_{f}") != F.col(f)) | (F.col(f"__hi_{f}") != F.col(f)))
    changed = _or([F.col(f"__set_{f}").isNotNull() & moved(f) for f in allowed])
    auto = AUTO_UPDATE_COLUMNS.get(table)
    if auto in df.columns:
        joined = joined.withColumn(auto, F.when(changed, _now(now)).otherwise(F.col(auto)))
    for f in allowed:
        joined = joined.withColumn(f, F.when(F.col(f"__set_{f}").isNotNull(), F.col(f"__set_{f}.v"))
                                   .otherwise(F.col(f)))
    return joined.select(*df.columns), rejected


def _unique_conflicts(table: str, df: DataFrame, probe: DataFrame, allowed: list[str],
                      change_key: str) -> DataFrame:
    """D10 on update: a patch that sets a unique column (a user's email) to a value that
    another row holds at that moment - compared insensitively - gets
    ``<column>:duplicate``. Patches count one by one: an accepted one frees the value its
    row held before, a refused one (also by another rule, or for an unknown row) frees and
    claims nothing."""
    pk = PRIMARY_KEYS[table]
    for t, column in UNIQUE_KEYS:
        if t != table or column not in allowed:
            continue
        setting = probe.filter((F.size("reasons") == 0) & F.array_contains("set_fields", column) & F.col(column).isNotNull())
        setting = setting.join(df.select(F.col(pk).alias("pk")), "pk", "left_semi")
        lost = one_by_one(claims_of(setting, F.col(change_key), F.col("pk"), [(0, insensitive(column))]),
                          claims_of(df, F.lit(0), F.col(pk), [(0, insensitive(column))]).drop("id"), 1)
        lost = lost.select(F.col("id").alias(change_key), codes([column]).alias("__dup"))
        probe = (probe.join(lost, change_key, "left")
                 .withColumn("reasons", F.when(F.col("__dup").isNotNull(), F.concat("reasons", "__dup")).otherwise(F.col("reasons")))
                 .drop("__dup"))
    return probe


# ---------------------------------------------------------------- D4 status

def apply_status_changes(issue: DataFrame, changes: DataFrame, now: str | Column | None = None,
                         change_key: str = "change_id") -> tuple[DataFrame, DataFrame]:
    """Status updates. A value outside the status list is rejected (V1); so
    is a change for an unknown issue. Every issue with an accepted change gets
    the last accepted status and ``updated_date = now`` (set even when the
    status is unchanged, as the procedure does). Valid changes are reduced to
    one row per issue before the single join with the issue table.
    Returns ``(new_issue, rejected)``."""
    valid = F.col("status").isNotNull() & F.col("status").isin(*ISSUE_STATUSES)
    good = changes.filter(valid)
    rejected = (changes.filter(~valid | F.col("status").isNull()).withColumn("reason", F.lit("status:not_allowed"))
                .unionByName(good.join(issue.select("issue_id"), "issue_id", "left_anti")
                             .withColumn("reason", F.lit(ISSUE_NOT_FOUND))))
    last = (good.groupBy("issue_id")
            .agg(F.max(F.struct(F.col(change_key).alias("k"), F.col("status").alias("v"))).alias("__last")))
    new = (issue.join(last, "issue_id", "left")
           .withColumn("status", F.coalesce(F.col("__last.v"), F.col("status")))
           .withColumn("updated_date", F.when(F.col("__last").isNotNull(), _now(now)).otherwise(F.col("updated_date")))
           .drop("__last"))
    return new.select(*issue.columns), rejected


# ---------------------------------------------------------------- D5 assignee

def apply_assignments(issue: DataFrame, user: DataFrame, changes: DataFrame, now: str | Column | None = None,
                      change_key: str = "change_id") -> tuple[DataFrame, DataFrame]:
    """Assignee updates (null = unassign). Only the user key is checked: an
    unknown user (or issue) is rejected. The last accepted value wins;
    ``updated_date`` moves only if some accepted change actually changed the
    value on the way (the column's on-update rule) — i.e. unless every accepted
    value equals the old one. Per issue the accepted changes are reduced to
    (last value, min, max, any null) before the single join with the issue
    table. Returns ``(new_issue, rejected)``."""
    users = user.select("user_id").distinct().withColumn("__user", F.lit(True))
    marked = lookup(changes, users, "assignee_id", "user_id", {"__user": "__user"}, spread_by=change_key)
    bad_user = F.col("assignee_id").isNotNull() & F.col("__user").isNull()
    good = marked.filter(~bad_user).drop("__user")
    rejected = (marked.filter(bad_user).drop("__user").withColumn("reason", F.lit("assignee_id:unknown_parent"))
                .unionByName(good.join(issue.select("issue_id"), "issue_id", "left_anti")
                             .withColumn("reason", F.lit(ISSUE_NOT_FOUND))))
    last = good.groupBy("issue_id").agg(
        F.max(F.struct(F.col(change_key).alias("k"), F.col("assignee_id").alias("v"))).alias("__last"),
        F.min("assignee_id").alias("__lo"), F.max("assignee_id").alias("__hi"),
        F.max(F.col("assignee_id").isNull().cast("int")).alias("__nul"))
    old = F.col("assignee_id")
    moved = F.when(old.isNull(), F.col("__hi").isNotNull()).otherwise(
        (F.col("__nul") == 1) | (F.col("__lo") != old) | (F.col("__hi") != old))
    new = (issue.join(last, "issue_id", "left")
           .withColumn("updated_date", F.when(F.col("__last").isNotNull() & moved, _now(now))
                       .otherwise(F.col("updated_date")))
           .withColumn("assignee_id", F.when(F.col("__last").isNotNull(), F.col("__last.v")).otherwise(old))
           .drop("__last", "__lo", "__hi", "__nul"))
    return new.select(*issue.columns), rejected


# ---------------------------------------------------------------- D6 sprint requests

def classify_sprint_requests(issue: DataFrame, sprint: DataFrame, requests: DataFrame) -> DataFrame:
    """D6 outcome per request: ``(request_id, issue_id, sprint_id, outcome, reason)``
    with outcome 'assigned', 'unassigned' or 'rejected'. Unknown issue → rejected
    ('Issue not found'); a sprint that is missing or in another project →
    rejected with the procedure's message."""
    iss = issue.select("issue_id", F.col("project_id").alias("__ip"))
    sp = sprint.select("sprint_id", F.col("project_id").alias("__sp"))
    # Unassign requests (null sprint) are spread, not sent to one task.
    j = lookup(requests.join(iss, "issue_id", "left"), sp, "sprint_id", "sprint_id", {"__sp": "__sp"},
               spread_by="request_id")
    reason = (F.when(F.col("__ip").isNull(), F.lit(ISSUE_NOT_FOUND))
              .when(F.col("sprint_id").isNotNull() & (F.col("__sp").isNull() | (F.col("__sp") != F.col("__ip"))),
                    F.lit(SPRINT_REJECTED)))
    outcome = (F.when(reason.isNotNull(), F.lit("rejected"))
               .when(F.col("sprint_id").isNull(), F.lit("unassigned")).otherwise(F.lit("assigned")))
    return j.select("request_id", "issue_id", "sprint_id", outcome.alias("outcome"), reason.alias("reason"))


def apply_sprint_requests(issue: DataFrame, sprint: DataFrame, requests: DataFrame,
                          now: str | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply the accepted requests (last per issue by ``request_id``):
    ``sprint_id`` = requested value and ``updated_date = now``. Returns
    ``(new_issue, outcomes)``."""
    outcomes = classify_sprint_requests(issue, sprint, requests)
    last = (outcomes.filter(F.col("outcome") != "rejected").groupBy("issue_id")
            .agg(F.max(F.struct(F.col("request_id").alias("k"), F.col("sprint_id").alias("v"))).alias("__last")))
    new = (issue.join(last, "issue_id", "left")
           .withColumn("sprint_id", F.when(F.col("__last").isNotNull(), F.col("__last.v")).otherwise(F.col("sprint_id")))
           .withColumn("updated_date", F.when(F.col("__last").isNotNull(), _now(now)).otherwise(F.col("updated_date")))
           .drop("__last"))
    return new.select(*issue.columns), outcomes


# ---------------------------------------------------------------- D7 deletes

def delete_cascade(tables: dict[str, DataFrame], table: str, keys: DataFrame,
                   key_col: str = "pk", materialize: bool | Collection[str] = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete ``keys`` from ``table`` and follow the key graph: children on a
    CASCADE key are deleted with their parent, children on a SET NULL key lose
    the reference. The graph has fixed depth, so this is a constant number of
    semi/anti joins in parent-before-child order — never a loop over data.
    Set-null rows keep their last-changed instant (cascaded changes fire no
    triggers).

    Returns ``(new_tables, report)`` with report rows ``(table_name, action, row_count)``
    where action is 'deleted' or 'set_null:<column>'.
    """
    pk = PRIMARY_KEYS[table]
    deleted: dict[str, DataFrame] = {
        table: tables[table].join(keys.select(F.col(key_col).alias(pk)), pk, "left_semi").select(pk)}
    order = [t for t in CASCADE_ORDER if t in tables]
    for child in order:
        if child == table:
            continue
        sources = [fk for fk in FOREIGN_KEYS if fk.child == child and fk.on_delete == "cascade" and fk.parent in deleted]
        if not sources:
            continue
        cpk = PRIMARY_KEYS[child]
        parts = [tables[child].join(deleted[fk.parent].select(F.col(fk.parent_key).alias(fk.column)), fk.column,
                                    "left_semi").select(cpk) for fk in sources]
        deleted[child] = functools.reduce(DataFrame.union, parts).distinct() if len(parts) > 1 else parts[0]
    if materialize:
        # Each key set feeds several joins below (cascade, set-null, report); write
        # it once to the shared checkpoint folder instead of re-deriving it (all of
        # them, or those of the tables that ``materialize`` names).
        checkpoint_dir(keys.sparkSession)
        deleted = {name: d.checkpoint(eager=True) if materialize is True or name in materialize else d for name, d in deleted.items()}
    new: dict[str, DataFrame] = {}
    report = []
    for name, df in tables.items():
        if name not in PRIMARY_KEYS:
            new[name] = df
            continue
        tpk = PRIMARY_KEYS[name]
        kept = df.join(deleted[name], tpk, "left_anti") if name in deleted else df
        if name in deleted:
            report.append(deleted[name].select(F.lit(name).alias("table_name"), F.lit("deleted").alias("action")))
        out = kept
        for fk in FOREIGN_KEYS:
            if fk.child != name or fk.on_delete != "set_null" or fk.parent not in deleted:
                continue
            gone = deleted[fk.parent].select(F.col(fk.parent_key).alias(fk.column))
            report.append(kept.join(gone, fk.column, "left_semi")
                          .select(F.lit(name).alias("table_name"), F.lit(f"set_null:{fk.column}").alias("action")))
            hit = gone.withColumn("__hit", F.lit(True))
            out = (lookup(out, hit, fk.column, fk.column, {"__hit": "__hit"}, spread_by=tpk)
                   .withColumn(fk.column, F.when(F.col("__hit").isNull(), F.col(fk.column)))
                   .drop("__hit"))
        new[name] = out.select(*df.columns)
    rep = functools.reduce(DataFrame.unionByName, report)
    counts = rep.groupBy("table_name", "action").agg(F.count(F.lit(1)).alias("row_count"))
    return new, counts


# ---------------------------------------------------------------- D9 issue_touch

def comment_edit_events(old: DataFrame, new: DataFrame, now: str | Column | None = None) -> DataFrame:
    """Touching events implied by a new comment snapshot: inserted comments, and
    comments whose text changed under the insensitive collation (a case-only
    edit is equal there, so it touches nothing). Deletions touch nothing.
    ``(issue_id, ts, kind)``."""
    o = old.select("comment_id", F.col("comment_text").alias("__old"))
    j = new.join(o, "comment_id", "left")
    kind = (F.when(F.col("__old").isNull(), F.lit("comment_insert"))
            .when(insensitive("__old") != insensitive("comment_text"), F.lit("comment_update")))
    return (j.select("issue_id", _now(now).alias("ts"), kind.alias("kind"))
            .filter(F.col("kind").isNotNull()))


def issue_touch(issue: DataFrame, events: DataFrame) -> DataFrame:
    """Replay touching events (comment insert, comment text edit, worklog
    insert, attachment insert) on the issues: ``updated_date`` becomes the
    newest of itself and the issue's touching events. Worklog edits/deletes,
    comment and attachment deletes do not touch."""
    last = (events.filter(F.col("kind").isin(*TOUCHING_KINDS) & F.col("ts").isNotNull())
            .groupBy("issue_id").agg(F.max("ts").alias("__touch")))
    new = (issue.join(last, "issue_id", "left")
           .withColumn("updated_date", F.greatest("updated_date", "__touch")).drop("__touch"))
    return new.select(*issue.columns)


# ---------------------------------------------------------------- D10 duplicates

def reject_duplicates(table: str, existing: DataFrame, new: DataFrame,
                      request_key: str = "request_id", rounds: int = ROUNDS) -> DataFrame:
    """``(request_key, accepted, reasons)`` for each new row, as if the requests came
    one by one: a row is refused when one of its unique natural keys (insensitive
    collation) is held by an existing row or by an earlier **accepted** request; a
    refused request holds no key. Exact for chains of any length (:mod:`.claims`);
    ``rounds`` only says how many set-based rounds come before chains are replayed.
    """
    pk = PRIMARY_KEYS[table]
    columns = [c for t, c in UNIQUE_KEYS if t == table and c in new.columns]
    rid, keys = F.col(request_key).cast("long"), [(k, insensitive(c)) for k, c in enumerate(columns)]
    requests = claims_of(new, rid, F.concat(F.lit("new "), rid.cast("string")), keys)
    held = claims_of(existing, F.lit(0), F.col(pk), keys).drop("id")
    lost = one_by_one(requests, held, max(2, len(columns)), rounds)
    out = new.select(rid.alias("id")).join(lost, "id", "left").withColumn(
        "reasons", F.coalesce(codes(columns), F.array().cast("array<string>")))
    return out.select(F.col("id").alias(request_key), (F.size("reasons") == 0).alias("accepted"), "reasons")
