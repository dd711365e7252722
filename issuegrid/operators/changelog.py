"""D1 with D3 to D8 as one mixed log: inserts, patches, status, assignee and sprint changes
and deletes of all tables, applied in ``change_id`` order as if they came one by one.

A change meets the tables as the changes before it left them: a comment on an issue that
an earlier change deleted is refused, one on an issue inserted earlier in the log is not.
Instead of replaying, every row gets a **lifetime** ``(born, died]`` in change ids:

* tables are settled parents before children (the order of the key graph), so a change that
  names a parent only has to find it alive at its ``change_id`` - an equi-join;
* a row dies with its first accepted delete or with the parent it cascades from;
* an issue inserted under an issue of the same log depends on that insert alone; such chains
  are resolved by pointer jumping (a chain of n inserts takes log n rounds);
* per row and field the last accepted setter wins, and a reference is null if the row it
  names has died since;
* the last-changed instant is that of the last change that really changed something: each
  setter is compared with the one before it. A row's setters are cut into blocks of change
  ids for that, so a hot row's are not one task's work.

Everything is joins, partial aggregates and bounded windows; the intermediate sets that
several steps read are written to the shared checkpoint folder.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AUTO_UPDATE_COLUMNS, CASCADE_ORDER, FOREIGN_KEYS, PATCH_ALLOW, PRIMARY_KEYS, SCHEMAS
from ..session import checkpoint_dir
from .changes import RAW_HOURS, shaped
from .common import lookup
from .lookup import insensitive, not_equal
from .quality import SAME_PROJECT_KEYS, row_rules

#: Actions of a log, by table. Unique keys stay with ``insert_rows`` and ``apply_patches``.
INSERTS = ("sprint", "issue", "comment", "worklog")
PATCHES = ("project", "sprint", "issue", "comment", "worklog")
ISSUE_ACTIONS = {"status": "status", "assign": "assignee_id", "sprint": "sprint_id"}
ALWAYS_TOUCHES = ("status", "sprint")        # the procedures set the instant even without a change
BLOCK = 1_000_000                            # change ids whose setters of one field are compared in one window
START = -1                                   # birth of the rows of the snapshot


def _alive(born: str, died: str) -> Column:
    """Whether a row with this lifetime is there when ``change_id`` comes."""
    return F.col(born).isNotNull() & (F.col(born) < F.col("change_id")) & (F.col(died).isNull() | (F.col(died) > F.col("change_id")))


def _add(reason: str | Column, when: Column) -> Column:
    return F.when(when, F.concat("reasons", F.array(F.lit(reason) if isinstance(reason, str) else reason))).otherwise(F.col("reasons"))


class _Log:
    """The tables' rows, lifetimes and outcomes while the log is settled table by table."""

    def __init__(self, tables: dict[str, DataFrame], log: DataFrame):
        self.tables, self.log = tables, log
        self.inserted: dict[str, DataFrame] = {}      # accepted inserts: rows + change_id, ts
        self.deaths: dict[str, DataFrame] = {}        # (key, died)
        self.accepted: dict[str, DataFrame] = {}      # accepted updates: log columns + fields
        self.refused: list[DataFrame] = []

    def of(self, table: str, *actions: str) -> DataFrame:
        return self.log.filter((F.col("table_name") == table) & F.col("action").isin(*actions))

    def refuse(self, changes: DataFrame) -> None:
        self.refused.append(changes.select("change_id", "table_name", "action", "pk", "reasons"))

    def rows(self, table: str, *columns: str) -> DataFrame:
        """All rows that ever live: ``key, born`` and ``columns``."""
        pk = F.col(PRIMARY_KEYS[table]).cast("long").alias("key")
        out = self.tables[table].select(pk, F.lit(START).cast("long").alias("born"), *columns)
        if table in self.inserted:
            out = out.unionByName(self.inserted[table].select(pk, F.col("change_id").alias("born"), *columns))
        return out

    def lives(self, table: str) -> DataFrame:
        """``key, born, died, project_id`` of all rows that ever live."""
        project = F.col("project_id") if "project_id" in self.tables[table].columns else F.lit(None).cast("int")
        out = self.rows(table, *(["project_id"] if "project_id" in self.tables[table].columns else []))
        return out.join(self.deaths[table], "key", "left").select("key", "born", "died", project.alias("project_id"))

    # ------------------------------------------------------------ references

    def check_reference(self, changes: DataFrame, table: str, column: str, parent: str, same_project: bool, when: Column | None = None) -> DataFrame:
        """``changes`` with reasons where ``column`` names no row of ``parent`` alive at that time."""
        lives = self.lives(parent).select(F.col("key").alias("__k"), "born", "died", F.col("project_id").alias("__project"))
        given = F.col(column).isNotNull() if when is None else F.col(column).isNotNull() & when
        met = lookup(changes.withColumn("__ref", F.when(given, F.col(column).cast("long"))), lives, "__ref", "__k",
                     {"born": "__born", "died": "__died", "__project": "__project"}, spread_by="change_id")
        met = met.withColumn("reasons", _add(f"{column}:unknown_parent", given & ~_alive("__born", "__died")))
        if same_project:
            met = met.withColumn("reasons", _add(f"{column}:other_project", given & _alive("__born", "__died") & (F.col("__project") != F.col("project_id"))))
        return met.drop("__ref", "__born", "__died", "__project")

    # ------------------------------------------------------------ inserts

    def settle_inserts(self, table: str) -> None:
        if table not in INSERTS:
            return
        pk = PRIMARY_KEYS[table]
        asked = self.of(table, "insert")
        columns = [c.alias(f.name) for f, c in shaped(table, asked, F.col("ts")) if f.name != pk]
        rows = asked.select("change_id", "ts", "table_name", "action", "pk", *columns)
        rules = [(code, broken) for code, broken in row_rules(table, rows.columns) if not code.startswith(f"{pk}:")]
        rows = rows.withColumn("reasons", F.array_compact(F.array(*[F.when(b, F.lit(c)) for c, b in rules])))
        # Ids come from a sequence: one that the table holds, or an earlier insert of the log named, is taken.
        taken = asked.groupBy("pk").agg(F.min("change_id").alias("__first"))
        held = self.tables[table].select(F.col(pk).cast("long").alias("pk"), F.lit(True).alias("__held"))
        rows = rows.join(taken, "pk", "left").join(held, "pk", "left")      # a null id matches nothing, and is refused
        rows = rows.withColumn("reasons", _add(f"{pk}:taken", F.col("pk").isNull() | F.col("__held").isNotNull() | (F.col("__first") < F.col("change_id")))).drop("__first", "__held")
        for fk in FOREIGN_KEYS:
            if fk.child == table and fk.parent != table and fk.parent in self.tables:
                rows = self.check_reference(rows, table, fk.column, fk.parent, table == "issue" and fk.column in SAME_PROJECT_KEYS)
        if table == "issue":
            rows = self._under_issues(rows)
        rows = rows.checkpoint()
        self.refuse(rows.filter(F.size("reasons") > 0))
        good = rows.filter(F.size("reasons") == 0)
        if "hours_logged" in good.columns:
            good = good.withColumn("hours_logged", F.bround("hours_logged", 2).cast(SCHEMAS[table]["hours_logged"].dataType))
        self.inserted[table] = good.withColumn(pk, F.col("pk").cast(SCHEMAS[table][pk].dataType)).select("change_id", "ts", *SCHEMAS[table].fieldNames())

    def _under_issues(self, rows: DataFrame) -> DataFrame:
        """``rows`` (issue inserts) with reasons where the parent issue is not there, of another
        project, or an insert of this log that is refused itself."""
        rows = rows.checkpoint()
        good = rows.filter(F.size("reasons") == 0)
        every = self.tables["issue"].select(F.col("issue_id").cast("long").alias("key"), F.lit(START).cast("long").alias("born"), "project_id").unionByName(
            good.select(F.col("pk").alias("key"), F.col("change_id").alias("born"), "project_id"))
        lives = every.join(self._first_deaths("issue", every), "key", "left").select(
            F.col("key").alias("__k"), "born", "died", F.col("project_id").alias("__project"))
        given = F.col("parent_issue_id").isNotNull()
        met = lookup(good.withColumn("__ref", F.col("parent_issue_id").cast("long")), lives, "__ref", "__k",
                     {"born": "__born", "died": "__died", "__project": "__project"}, spread_by="change_id")
        stands = ~given | (_alive("__born", "__died") & (F.col("__project") == F.col("project_id")))
        # Pointer jumping: a row stands if its parent insert stands; then it points to that one's parent.
        state = met.select(F.col("pk").alias("key"), F.when(given & (F.col("__born") > START), F.col("__ref")).alias("__on"),
                           F.coalesce(stands, F.lit(False)).alias("stands")).checkpoint()
        while not state.filter(F.col("stands") & F.col("__on").isNotNull()).isEmpty():
            above = state.filter("stands").select(F.col("key").alias("__on"), F.col("__on").alias("__next"), F.lit(True).alias("__above"))
            state = state.join(above, "__on", "left").select(
                "key", F.col("__next").alias("__on"), (F.col("stands") & (F.col("__on").isNull() | F.coalesce("__above", F.lit(False)))).alias("stands")).checkpoint()
        # Every reason is told against the issues that stand.
        standing = good.join(state.filter("stands").select(F.col("key").alias("pk")), "pk", "left_semi")
        self.inserted["issue"] = standing.select(F.col("pk").alias("issue_id"), "change_id", "project_id")
        self.settle_deaths("issue", tell=False)
        return self.check_reference(rows, "issue", "parent_issue_id", "issue", True)

    # ------------------------------------------------------------ deletes

    def _first_deaths(self, table: str, rows: DataFrame) -> DataFrame:
        """``(key, died)`` of the ``rows (key, born, cascading keys)`` that a delete or a parent takes."""
        asked = self.of(table, "delete").select(F.col("pk").alias("key"), F.col("change_id").alias("died"))
        parts = [rows.select("key", "born").join(asked, "key")]
        for fk in FOREIGN_KEYS:
            if fk.child == table and fk.on_delete == "cascade" and fk.parent in self.deaths:
                gone = self.deaths[fk.parent].select(F.col("key").alias(fk.column), "died")
                parts.append(rows.select("key", "born", F.col(fk.column).cast("long").alias(fk.column)).join(gone, fk.column).select("key", "born", "died"))
        every = functools.reduce(DataFrame.unionByName, parts).filter(F.col("died") > F.col("born"))
        return every.groupBy("key").agg(F.min("died").alias("died"))

    def settle_deaths(self, table: str, tell: bool = True) -> None:
        keys = [fk.column for fk in FOREIGN_KEYS if fk.child == table and fk.on_delete == "cascade" and fk.parent in self.deaths]
        self.deaths[table] = self._first_deaths(table, self.rows(table, *keys)).checkpoint()
        if not tell:
            return
        asked = self.of(table, "delete").join(self.deaths[table].select(F.col("key").alias("pk"), "died"), "pk", "left")
        # Only the change that a row died of is a delete that found it.
        self.refuse(asked.filter(~F.coalesce(F.col("died") == F.col("change_id"), F.lit(False))).withColumn(
            "reasons", F.array(F.lit(f"{PRIMARY_KEYS[table]}:not_found"))))

    # ------------------------------------------------------------ updates

    def settle_updates(self, table: str) -> None:
        pk, types = PRIMARY_KEYS[table], {f.name: f.dataType for f in SCHEMAS[table].fields}
        fields = [f for f in PATCH_ALLOW.get(table, ()) if f in self.log.columns]
        own = {a: f for a, f in ISSUE_ACTIONS.items() if table == "issue"}
        if table not in PATCHES:
            return
        allowed = F.array(*[F.lit(f) for f in fields]).cast("array<string>")
        named = F.array_intersect(F.coalesce("set_fields", F.array().cast("array<string>")), allowed)
        for action, field in own.items():
            named = F.when(F.col("action") == action, F.array(F.lit(field))).otherwise(named)
        fields = fields + [f for f in own.values() if f not in fields]
        probe = self.of(table, "patch", *own).select(
            "change_id", "ts", "table_name", "action", "pk", named.alias("fields"),
            *[F.col(f).cast(RAW_HOURS if f == "hours_logged" else types[f]).alias(f) for f in fields])
        sets = lambda f: F.array_contains("fields", f)
        checks = [F.when(sets(code.split(":")[0]) & broken, F.lit(code)) for code, broken in row_rules(table, fields)]
        probe = probe.withColumn("reasons", F.array_compact(F.array(*checks)).cast("array<string>"))
        lives = self.lives(table).select(F.col("key").alias("__k"), "born", "died", "project_id")
        probe = lookup(probe, lives, "pk", "__k", {"born": "__born", "died": "__died", "project_id": "project_id"}, spread_by="change_id")
        probe = probe.withColumn("reasons", F.when(_alive("__born", "__died"), F.col("reasons")).otherwise(F.array(F.lit(f"{pk}:not_found")))).drop("__born", "__died")
        for fk in FOREIGN_KEYS:
            if fk.child == table and fk.column in fields and fk.parent in self.tables:
                probe = self.check_reference(probe, table, fk.column, fk.parent, fk.column == "sprint_id",
                                             sets(fk.column) & ~F.array_contains("reasons", f"{pk}:not_found"))
        probe = probe.checkpoint()
        self.refuse(probe.filter(F.size("reasons") > 0))
        good = probe.filter(F.size("reasons") == 0)
        if "hours_logged" in fields:
            good = good.withColumn("hours_logged", F.when(sets("hours_logged"), F.bround("hours_logged", 2)).cast(types["hours_logged"]))
        self.accepted[table] = good.select("change_id", "ts", "action", "pk", "fields", *fields)

    # ------------------------------------------------------------ what really changed

    def real_changes(self, table: str) -> DataFrame:
        """``(pk, field, change_id, ts, action, before, after)`` of accepted setters that changed
        their field; values as strings."""
        good = self.accepted[table]
        fields = good.columns[5:]
        value = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("after"))
        sets = good.select("pk", "change_id", "ts", "action", "fields", F.explode(F.array(*[value(f) for f in fields])).alias("x")).filter(
            F.array_contains("fields", F.col("x.field"))).select("pk", "x.field", "change_id", "ts", "action", "x.after").withColumn(
            "block", F.floor(F.col("change_id") / BLOCK))
        inside = Window.partitionBy("pk", "field", "block").orderBy("change_id")
        sets = sets.withColumn("last", F.lag(F.struct("change_id", "after")).over(inside))
        ends = sets.groupBy("pk", "field", "block").agg(F.max(F.struct("change_id", "after")).alias("end"))
        earlier = ends.withColumn("earlier", F.lag("end").over(Window.partitionBy("pk", "field").orderBy("block"))).select("pk", "field", "block", "earlier")
        base = self.base(table).join(good.select("pk").distinct(), "pk", "left_semi")
        base = base.select("pk", "born", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")).select(
            "pk", "x.field", F.struct(F.col("born").alias("change_id"), F.col("x.v").alias("after")).alias("base"))
        sets = sets.join(earlier, ["pk", "field", "block"]).join(base, ["pk", "field"]).select(
            "pk", "field", "change_id", "ts", "action", "after", F.coalesce("last", "earlier", "base").alias("x"))
        sets = sets.select("pk", "field", "change_id", "ts", "action", "after", F.col("x.after").alias("before"))
        for fk in FOREIGN_KEYS:                       # a reference was null again once its row had died
            if fk.child == table and fk.on_delete == "set_null" and fk.column in fields and fk.parent in self.deaths:
                gone = self.deaths[fk.parent].select(F.col("key").cast("string").alias("__k"), F.col("died").alias("__died"))
                sets = lookup(sets.withColumn("__ref", F.when(F.col("field") == fk.column, F.col("before"))), gone, "__ref", "__k",
                              {"__died": "__died"}, spread_by="change_id")
                sets = sets.withColumn("before", F.when(F.col("__died") < F.col("change_id"), F.lit(None)).otherwise(F.col("before"))).drop("__ref", "__died")
        return sets.filter(not_equal("before", "after"))

    def base(self, table: str) -> DataFrame:
        """All rows that ever live as they began, with ``pk`` and ``born``."""
        pk, columns = PRIMARY_KEYS[table], self.tables[table].columns
        out = self.tables[table].select(*columns, F.lit(START).cast("long").alias("born"))
        if table in self.inserted:
            mine = [F.col(c) if c in self.inserted[table].columns else F.lit(None).alias(c) for c in columns]
            out = out.unionByName(self.inserted[table].select(*mine, F.col("change_id").alias("born")))
        return out.withColumn("pk", F.col(pk).cast("long"))

    def touches(self, table: str) -> DataFrame | None:
        """``(pk, change_id, ts)`` of the changes that move the row's last-changed instant."""
        parts = []
        if table in self.accepted:
            parts.append(self.real_changes(table).select("pk", "change_id", "ts"))
            parts.append(self.accepted[table].filter(F.col("action").isin(*ALWAYS_TOUCHES)).select("pk", "change_id", "ts"))
        if table == "issue":
            for child in ("comment", "worklog"):      # D9: inserts of children touch their issue
                if child in self.inserted:
                    parts.append(self.inserted[child].select(F.col("issue_id").cast("long").alias("pk"), "change_id", "ts"))
            if "comment" in self.accepted:            # and edits of a comment beyond letter case
                edits = self.real_changes("comment").filter((F.col("field") == "comment_text") & (insensitive("before") != insensitive("after")))
                issues = self.base("comment").select("pk", F.col("issue_id").cast("long").alias("issue"))
                parts.append(edits.join(issues, "pk").select(F.col("issue").alias("pk"), "change_id", "ts"))
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    # ------------------------------------------------------------ new tables

    def result(self, table: str) -> DataFrame:
        columns = self.tables[table].columns
        out = self.base(table).join(self.deaths[table].select(F.col("key").alias("pk")), "pk", "left_anti")
        if table in self.accepted:
            fields = [f for f in self.accepted[table].columns[5:] if f in columns]
            last = self.accepted[table].groupBy("pk").agg(*[
                F.max(F.when(F.array_contains("fields", f), F.struct(F.col("change_id").alias("k"), F.col(f).alias("v")))).alias(f"__set_{f}") for f in fields])
            out = out.join(last, "pk", "left")
            for f in fields:
                out = out.withColumn(f, F.when(F.col(f"__set_{f}").isNotNull(), F.col(f"__set_{f}.v")).otherwise(F.col(f))).drop(f"__set_{f}")
        for fk in FOREIGN_KEYS:
            if fk.child == table and fk.on_delete == "set_null" and fk.column in columns and fk.parent in self.deaths:
                gone = self.deaths[fk.parent].select(F.col("key").alias("__k"), F.lit(True).alias("__gone"))
                out = lookup(out.withColumn("__ref", F.col(fk.column).cast("long")), gone, "__ref", "__k", {"__gone": "__gone"}, spread_by="pk")
                out = out.withColumn(fk.column, F.when(F.col("__gone").isNull(), F.col(fk.column))).drop("__ref", "__gone")
        auto, touches = AUTO_UPDATE_COLUMNS.get(table), self.touches(table)
        if auto in columns and touches is not None:
            when = touches.groupBy("pk").agg(F.max(F.struct("change_id", "ts")).alias("__touch"))
            out = out.join(when, "pk", "left").withColumn(auto, F.coalesce("__touch.ts", auto))
        return out.select(*columns)


def apply_log(tables: dict[str, DataFrame], log: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Apply a mixed change log; returns ``(new_tables, refused)``.

    ``log``: ``change_id`` (unique, in order), ``ts``, ``table_name``, ``action``, ``pk`` (for an
    insert the id reserved for the row, see :mod:`.sequence`), ``set_fields`` (of a patch) and
    one column for every field that a change carries. Actions: ``delete`` for every table;
    ``insert`` for :data:`INSERTS`; ``patch`` for :data:`PATCHES`; ``status``, ``assign`` and
    ``sprint`` for issues. ``refused``: ``change_id, table_name, action, pk, reasons`` - broken
    row rules, ``<column>:unknown_parent`` (not there at that moment),
    ``<column>:other_project``, ``<pk>:not_found``, ``<pk>:taken`` and ``action:not_supported``.
    """
    checkpoint_dir(log.sparkSession)
    state = _Log(tables, log)
    order = [t for t in CASCADE_ORDER if t in tables]
    for table in order:
        state.settle_inserts(table)
        state.settle_deaths(table)
    for table in order:
        state.settle_updates(table)
    known = functools.reduce(Column.__or__, [
        (F.col("table_name") == t) & F.col("action").isin("delete", *(["insert"] if t in INSERTS else []), *(["patch"] if t in PATCHES else []),
                                                       *(ISSUE_ACTIONS if t == "issue" else [])) for t in order])
    state.refuse(log.filter(~F.coalesce(known, F.lit(False))).withColumn("reasons", F.array(F.lit("action:not_supported"))))
    return {t: state.result(t) for t in order}, functools.reduce(DataFrame.unionByName, state.refused)
