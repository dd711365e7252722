"""Reports and checks kept up to date: stored results and the rows that changed.

A change of a table is a signed set of rows: what is no longer there with sign -1, what is
there now with +1 (an updated row gives both). From it and the stored result of last time
the new result follows without aggregating the whole tables again:

* counts and sums (A1 to A6, A9) add the signed rows to the stored totals; a group leaves
  when its row (or its last contributing row) does;
* a joined total (A2, A3) follows the product rule: changed worklogs with the old issues,
  and the worklogs of the few issues that came, went or moved, as they are now;
* the last activity (A7) cannot be subtracted from: an issue that lost its newest touch is
  recomputed from its own rows, all others take the later of old and new;
* key checks (V11 to V13) look again only at changed rows and at children of changed parents.

Primary keys are unique. The tables keep their foreign keys for A1 and A4 to A7 (the change
operators see to that); A2, A3 and the checks hold without. Results are those of the functions of
``reports`` and ``quality`` over the new tables.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FOREIGN_KEYS, HOURS_SUM, PRIMARY_KEYS
from ..session import checkpoint_dir
from .common import hours_sum
from .enrich import worklog_with_project
from .reports import issue_last_activity, touch_events

SIGN, WAS, IS = "__sign", "__was", "__is"
ROLES = {"reporter": "reporter_id", "assignee": "assignee_id"}


def changed_rows(old: DataFrame, new: DataFrame, keys: DataFrame | None = None, pk: str | None = None) -> DataFrame:
    """The signed rows between two states of a table (one grouping over both; equal rows
    cancel). With ``keys`` (the ``pk`` values that the change named) only those rows are read on.

    Rows are dealt out by all their columns before they are grouped: hardly two rows of one task
    are equal before that, so grouping there would hold (and spill) whole input splits in vain."""
    if keys is not None:
        old, new = (df.join(keys.select(pk).distinct(), pk, "left_semi").select(*old.columns) for df in (old, new))
    both = old.select("*", F.lit(-1).alias(SIGN)).unionByName(new.select(*old.columns, F.lit(1).alias(SIGN)))
    return both.repartition(*old.columns).groupBy(*old.columns).agg(F.sum(SIGN).alias(SIGN)).where(F.col(SIGN) != 0)


def both_states(old: DataFrame, new: DataFrame, dealt_by: str | None = None) -> DataFrame:
    """The distinct rows of two states of a table and how often each is there before
    (:data:`WAS`) and after (:data:`IS`): the signed rows and the new state are read from it.

    Rows are dealt out as in :func:`changed_rows`. ``dealt_by`` names the key by which the plan of
    ``new`` has its rows dealt out already (its last step joins on it): then the old rows alone are
    dealt out in the same way, and the union of both is grouped where it is."""
    if dealt_by is not None:
        old = old.repartition(dealt_by)
    both = (old.select("*", F.lit(1).alias(WAS), F.lit(0).alias(IS))
            .unionByName(new.select(*old.columns, F.lit(0).alias(WAS), F.lit(1).alias(IS))))
    if dealt_by is None:
        both = both.repartition(*old.columns)
    return both.groupBy(*old.columns).agg(F.sum(WAS).cast("int").alias(WAS), F.sum(IS).cast("int").alias(IS))


def signed_rows(both: DataFrame) -> DataFrame:
    """:func:`changed_rows` of :func:`both_states`."""
    return both.where(F.col(WAS) != F.col(IS)).withColumn(SIGN, (F.col(IS) - F.col(WAS)).cast("long")).drop(WAS, IS)


def rows_after(both: DataFrame) -> DataFrame:
    """The new state of :func:`both_states`, equal rows as often as they are there. Only further
    copies of a row are exploded: the others stay a plain scan, which joins filter as they read."""
    columns = [c for c in both.columns if c not in (WAS, IS)]
    copies = both.where(F.col(IS) > 1).select(*columns, F.explode(F.array_repeat(F.lit(1), F.col(IS) - 1)).alias(IS))
    return both.where(F.col(IS) > 0).select(*columns).unionByName(copies.select(*columns))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, as Parquet: it feeds several results,
    and each reads back only the columns it needs. (An eager ``checkpoint`` computes its last stage
    twice, sorts included, and writes whole rows.)"""
    path = f"{checkpoint_dir(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Written(Mapping):
    """Tables by name, each written once (:func:`saved`) when it is first read: a report pays
    for the tables that it reads, several reports over the same tables pay once."""

    def __init__(self, tables: Mapping[str, DataFrame], of: Callable[[str], DataFrame] | None = None):
        self._names, self._of, self._done = list(tables), of or tables.__getitem__, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._done:
            self._done[name] = saved(self._of(name))
        return self._done[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


class Derived(Mapping):
    """Tables by name, each made of the table of that name in ``tables``."""

    def __init__(self, tables: Mapping[str, DataFrame], make: Callable[[DataFrame], DataFrame]):
        self._tables, self._make = tables, make

    def __getitem__(self, name: str) -> DataFrame:
        return self._make(self._tables[name])

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)


def changes_between(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame],
                    columns: Mapping[str, tuple[str, ...]] | None = None) -> Mapping[str, DataFrame]:
    """:func:`changed_rows` of every table, each written once when it is first read. With
    ``columns`` the tables named there are compared in those columns only: a report that reads no
    others gets the same sums from them (a row that changed elsewhere would count -1 and +1)."""
    if columns is None:
        return Written(old, lambda name: changed_rows(old[name], new[name]))
    return compared(old, new, columns)[1]


def compared(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], columns: Mapping[str, tuple[str, ...]],
             dealt_by: Mapping[str, str] | None = None) -> tuple[Mapping[str, DataFrame], Mapping[str, DataFrame]]:
    """The new state and :func:`changes_between` in ``columns``, both from one copy a table
    (:func:`both_states`) that is written when one of them is first read: the new state is
    neither written nor dealt out again to be compared. ``dealt_by`` as there, by table."""
    both = Written(columns, lambda name: both_states(old[name].select(*columns[name]), new[name].select(*columns[name]),
                                                     (dealt_by or {}).get(name)))
    return Derived(both, rows_after), Derived(both, signed_rows)


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _added(stored: DataFrame, keys: list[str], figures: list[str], changes: list[DataFrame], members: DataFrame) -> DataFrame:
    """Stored totals plus signed changes, in one grouping. ``members`` are the signed rows that
    give each group its place: a new one starts at zero, one that went takes its group along."""
    types = {f: stored.schema[f].dataType for f in figures}
    zero = [F.lit(0).cast(types[f]).alias(f) for f in figures]
    parts = [stored.select(*keys, *figures, F.lit(1).cast("long").alias(SIGN)),
             members.select(*keys, *zero, F.col(SIGN).cast("long").alias(SIGN))]
    parts += [c.select(*keys, *[F.col(f).cast(types[f]).alias(f) if f in c.columns else z for f, z in zip(figures, zero, strict=True)],
                       F.lit(0).cast("long").alias(SIGN)) for c in changes]
    total = _union(parts).groupBy(*keys).agg(*[F.sum(f).cast(types[f]).alias(f) for f in figures], F.sum(SIGN).alias(SIGN))
    return total.where(F.col(SIGN) > 0).select(*keys, *figures)


def _signed(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column) * F.col(SIGN)


def issue_hours(stored: DataFrame, delta: dict[str, DataFrame]) -> DataFrame:
    """A1 after a change: ``(issue_id, total_hours)``."""
    logged = delta["worklog"].groupBy("issue_id").agg(hours_sum(_signed("hours_logged")).alias("total_hours"))
    return _added(stored, ["issue_id"], ["total_hours"], [logged], delta["issue"])


def user_project_hours(issue: DataFrame, worklog: DataFrame) -> DataFrame:
    """The stored state of A2 and A3: ``(project_id, user_id, hours, logs)``, worklogs without
    a user under the null user. Worklogs meet their issue unsummed: sums per issue and user are
    hardly fewer rows and would be shuffled once more (a hot issue is split by the skew join)."""
    return (worklog_with_project(worklog, issue).groupBy("project_id", "user_id")
            .agg(hours_sum("hours_logged").alias("hours"), F.count(F.lit(1)).alias("logs")))


def user_project_hours_after(stored: DataFrame, old_issue: DataFrame, new_worklog: DataFrame, delta: dict[str, DataFrame]) -> DataFrame:
    """That state after a change. Old issues are read in two columns and joined to the changed
    worklogs; new worklogs are joined only to issues that came, went or changed project."""
    logged = worklog_with_project(delta["worklog"], old_issue).groupBy("project_id", "user_id").agg(
        F.sum(_signed("hours_logged")).alias("h"), F.sum(SIGN).alias("n"))
    moved = delta["issue"].groupBy("issue_id", "project_id").agg(F.sum(SIGN).alias(SIGN)).where(F.col(SIGN) != 0)
    resettled = new_worklog.join(moved, "issue_id").groupBy("project_id", "user_id").agg(
        F.sum(_signed("hours_logged")).alias("h"), F.sum(SIGN).alias("n"))
    parts = [stored] + [c.select("project_id", "user_id", F.col("h").cast(HOURS_SUM).alias("hours"), F.col("n").cast("long").alias("logs"))
                        for c in (logged, resettled)]
    return (_union(parts).groupBy("project_id", "user_id").agg(hours_sum("hours").alias("hours"), F.sum("logs").alias("logs"))
            .where(F.col("logs") > 0))


def hours_by_user(state: DataFrame, user: DataFrame) -> DataFrame:
    """A3 from the state: ``(project_id, user_id, username, total_user_hours)``."""
    return (state.where(F.col("user_id").isNotNull()).join(user.select("user_id", "username"), "user_id")
            .select("project_id", "user_id", "username", F.col("hours").alias("total_user_hours")))


def project_hours(state: DataFrame, project: DataFrame) -> DataFrame:
    """A2 from the state: ``(project_id, total_hours)``, zero-filled."""
    per_project = state.groupBy("project_id").agg(hours_sum("hours").alias("total_hours"))
    return project.select("project_id").join(per_project, "project_id", "left").select(
        "project_id", F.coalesce("total_hours", F.lit(0).cast(HOURS_SUM)).alias("total_hours"))


def user_issue_counts(stored: DataFrame, delta: dict[str, DataFrame]) -> DataFrame:
    """A4 after a change: ``(user_id, role, issue_count)``."""
    pairs = delta["issue"].select(SIGN, F.explode(F.array(*[F.struct(F.col(c).alias("user_id"), F.lit(r).alias("role")) for r, c in ROLES.items()])).alias("p"))
    counts = pairs.where(F.col("p.user_id").isNotNull()).groupBy("p.user_id", "p.role").agg(F.sum(SIGN).alias("issue_count"))
    members = delta["user"].select("user_id", F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role"), SIGN)
    return _added(stored, ["user_id", "role"], ["issue_count"], [counts], members)


def project_issue_counts(stored: DataFrame, delta: dict[str, DataFrame]) -> DataFrame:
    """A5 after a change: ``(project_id, issue_count)``."""
    counts = delta["issue"].groupBy("project_id").agg(F.sum(SIGN).alias("issue_count"))
    return _added(stored, ["project_id"], ["issue_count"], [counts], delta["project"])


def issue_child_counts(stored: DataFrame, delta: dict[str, DataFrame]) -> DataFrame:
    """A6 after a change: ``(issue_id, comment_count, worklog_count, attachment_count)``."""
    names = ("comment", "worklog", "attachment")
    counts = [delta[n].groupBy("issue_id").agg(F.sum(SIGN).alias(f"{n}_count")) for n in names]
    return _added(stored, ["issue_id"], [f"{n}_count" for n in names], counts, delta["issue"])


def issue_last_activity_after(stored: DataFrame, new: dict[str, DataFrame], delta: dict[str, DataFrame]) -> DataFrame:
    """A7 after a change: ``(issue_id, last_activity)``. Only issues that lost their newest
    touch, with none as new in its place, are recomputed from the new tables."""
    def touches(side):
        rows = {n: delta[n].where(side) for n in ("comment", "worklog", "attachment", "issue")}
        own = rows["issue"].select("issue_id", F.col("updated_date").alias("ts"))
        return touch_events(rows["comment"], rows["worklog"], rows["attachment"]).select("issue_id", "ts").unionByName(own)

    none, no_one = F.lit(None).cast("timestamp"), F.lit(0).cast("long")
    parts = [stored.select("issue_id", F.col("last_activity").alias("was"), none.alias("came"), none.alias("went"), F.lit(1).cast("long").alias(SIGN)),
             touches(F.col(SIGN) > 0).select("issue_id", none.alias("was"), F.col("ts").alias("came"), none.alias("went"), no_one.alias(SIGN)),
             touches(F.col(SIGN) < 0).select("issue_id", none.alias("was"), none.alias("came"), F.col("ts").alias("went"), no_one.alias(SIGN)),
             delta["issue"].select("issue_id", none.alias("was"), none.alias("came"), none.alias("went"), F.col(SIGN).cast("long").alias(SIGN))]
    folded = saved(_union(parts).groupBy("issue_id").agg(*[F.max(c).alias(c) for c in ("was", "came", "went")], F.sum(SIGN).alias(SIGN))
                   .where(F.col(SIGN) > 0)
                   .withColumn("again", F.coalesce(F.col("went") >= F.col("was"), F.lit(False)) & ~F.coalesce(F.col("came") >= F.col("went"), F.lit(False))))
    again = folded.where("again").select("issue_id")
    own = {n: new[n].join(again, "issue_id", "left_semi") for n in ("issue", "comment", "worklog", "attachment")}
    recomputed = issue_last_activity(own["issue"], touch_events(own["comment"], own["worklog"], own["attachment"]))
    return folded.where(~F.col("again")).select("issue_id", F.greatest("was", "came").alias("last_activity")).unionByName(recomputed)


def sprint_counts(sprint: DataFrame) -> DataFrame:
    """The stored sprint counts of A9: ``(project_id, sprint_count)``."""
    return sprint.groupBy("project_id").agg(F.count(F.lit(1)).alias("sprint_count"))


def project_report(project: DataFrame, hours: DataFrame, issue_counts: DataFrame, sprints: DataFrame, users: DataFrame) -> DataFrame:
    """A9 from kept figures: A2 ``hours``, A5 ``issue_counts``, ``sprints`` and A3 ``users``."""
    out = project.select("project_id", "project_key", "project_name", "status")
    for figures in (hours, issue_counts, sprints, users):
        out = out.join(figures, "project_id", "left")
    none = F.lit(0).cast("long")
    return out.select("project_id", "project_key", "project_name", "status", "total_hours", F.coalesce("issue_count", none).alias("issue_count"),
                      F.coalesce("sprint_count", none).alias("sprint_count"), "user_id", "username", "total_user_hours")


def sprint_counts_after(stored: DataFrame, delta: dict[str, DataFrame]) -> DataFrame:
    """Those counts after a change."""
    counts = delta["sprint"].groupBy("project_id").agg(F.sum(SIGN).alias("sprint_count"))
    return (stored.unionByName(counts).groupBy("project_id").agg(F.sum("sprint_count").alias("sprint_count")).where(F.col("sprint_count") > 0))


# ---------------------------------------------------------------- key checks

def _flow(delta: DataFrame, key: str) -> DataFrame:
    """Keys of a table with how many rows each gained."""
    return delta.groupBy(key).agg(F.sum(SIGN).alias(SIGN))


def fk_violations(stored: DataFrame, new: dict[str, DataFrame], delta: dict[str, DataFrame]) -> DataFrame:
    """V11 after a change: the stored findings without those of changed rows and of keys that
    came back, plus what the changed rows and the children of lost parents break. Parents
    are read in their key column, children in their keys."""
    ids = _union([delta[t].select(F.lit(t).alias("child_table"), F.col(PRIMARY_KEYS[t]).cast("long").alias("child_id"))
                  for t in delta]).distinct()
    came, found = [], []
    for fk in FOREIGN_KEYS:
        if fk.child not in new or fk.parent not in new:
            continue
        pk = PRIMARY_KEYS[fk.child]
        name = [F.lit(fk.child).alias("child_table"), F.lit(fk.column).alias("fk_column")]
        flow = _flow(delta[fk.parent], fk.parent_key)
        came.append(flow.where(F.col(SIGN) > 0).select(*name, F.col(fk.parent_key).cast("long").alias("missing_key")))
        row = [*name, F.col(pk).cast("long").alias("child_id"), F.col(fk.column).cast("long").alias("missing_key")]
        parents = new[fk.parent].select(F.col(fk.parent_key).alias(fk.column))
        changed = delta[fk.child].where((F.col(SIGN) > 0) & F.col(fk.column).isNotNull()).select(pk, fk.column)
        gone = flow.where(F.col(SIGN) < 0).select(F.col(fk.parent_key).alias(fk.column))
        left = (new[fk.child].select(pk, fk.column).join(gone, fk.column, "left_semi")
                .join(delta[fk.child].select(pk), pk, "left_anti").select(pk, fk.column))
        found.append(changed.unionByName(left).join(parents, fk.column, "left_anti").select(*row))
    kept = stored.join(ids, ["child_table", "child_id"], "left_anti").join(
        _union(came), ["child_table", "fk_column", "missing_key"], "left_anti")
    return kept.select("child_table", "fk_column", "child_id", "missing_key").unionByName(_union(found))


def parent_project_mismatch(stored: DataFrame, new_issue: DataFrame, delta: dict[str, DataFrame]) -> DataFrame:
    """V13 after a change: ``(issue_id, parent_issue_id, project_id)``; changed issues and the
    children of changed issues are judged again."""
    moved = delta["issue"].select("issue_id").distinct()
    narrow = new_issue.select("issue_id", "parent_issue_id", "project_id")
    children = narrow.join(moved.select(F.col("issue_id").alias("parent_issue_id")), "parent_issue_id", "left_semi").select("issue_id")
    again = saved(moved.unionByName(children).distinct())
    parents = new_issue.select(F.col("issue_id").alias("parent_issue_id"), "project_id")
    found = (narrow.where(F.col("parent_issue_id").isNotNull()).join(again, "issue_id", "left_semi")
             .join(parents, ["parent_issue_id", "project_id"], "left_anti").select("issue_id", "parent_issue_id", "project_id"))
    return stored.join(again, "issue_id", "left_anti").select("issue_id", "parent_issue_id", "project_id").unionByName(found)


def sprint_project_mismatch(stored: DataFrame, new: dict[str, DataFrame], delta: dict[str, DataFrame]) -> DataFrame:
    """V12 after a change: ``(issue_id, sprint_id, issue_project_id, sprint_project_id)``; changed
    issues and the issues of changed sprints are judged again."""
    narrow = new["issue"].where(F.col("sprint_id").isNotNull()).select("issue_id", "sprint_id", F.col("project_id").alias("issue_project_id"))
    members = narrow.join(delta["sprint"].select("sprint_id").distinct(), "sprint_id", "left_semi").select("issue_id")
    again = saved(delta["issue"].select("issue_id").unionByName(members).distinct())
    sprints = new["sprint"].select("sprint_id", F.col("project_id").alias("sprint_project_id"))
    found = narrow.join(again, "issue_id", "left_semi").join(sprints, "sprint_id").where(F.col("issue_project_id") != F.col("sprint_project_id"))
    cols = ["issue_id", "sprint_id", "issue_project_id", "sprint_project_id"]
    return stored.join(again, "issue_id", "left_anti").select(*cols).unionByName(found.select(*cols))
