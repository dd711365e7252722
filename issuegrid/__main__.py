"""Command line: run a report or check over tracker tables stored as Parquet.

    python -m issuegrid <name> --tables DIR --out DIR [--format parquet|json]
    python -m issuegrid --list

``DIR`` holds ``<table>.parquet`` for the seven tables (``sources.tables.load``).
The result is written to ``--out`` (JSON keeps null fields). The session comes
from the environment (``spark-submit`` settings apply); ``spark.checkpoint.dir``
must name a shared folder on a cluster.
"""

from __future__ import annotations

import argparse
import sys

from .operators import access, details, enrich, quality, reports


def _reports():
    return {
        "hours_by_user": lambda t: reports.hours_by_user(t["issue"], t["worklog"], t["user"]),
        "issue_hours": lambda t: reports.issue_hours(t["issue"], t["worklog"]),
        "project_hours": lambda t: reports.project_hours(t["project"], t["issue"], t["worklog"]),
        "user_issue_counts": lambda t: reports.user_issue_counts(t["user"], t["issue"]),
        "project_issue_counts": lambda t: reports.project_issue_counts(t["project"], t["issue"]),
        "issue_child_counts": lambda t: reports.issue_child_counts(t["issue"], t["comment"], t["worklog"],
                                                                   t["attachment"]),
        "issue_last_activity": lambda t: reports.issue_last_activity(
            t["issue"], reports.touch_events(t["comment"], t["worklog"], t["attachment"])),
        "project_report": lambda t: reports.project_report(t["project"], t["sprint"], t["issue"], t["worklog"],
                                                           t["user"]),
        "issue_enriched": lambda t: enrich.issue_enriched(t["issue"], t["project"], t["sprint"], t["user"]),
        "issue_details": lambda t: details.issue_details(t["issue"], t["project"], t["sprint"], t["user"],
                                                         t["comment"], t["worklog"], t["attachment"]),
        "fk_violations": quality.fk_violations,
        "duplicate_keys": quality.duplicate_keys,
        "violation_counts": quality.violation_counts,
        "can_read_issue": lambda t: access.can_read_issue(t["project"], t["issue"]),
        "can_write_issue": lambda t: access.can_write_issue(t["project"], t["issue"]),
    }


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="issuegrid", description=__doc__.split("\n\n")[0])
    p.add_argument("name", nargs="?")
    p.add_argument("--tables")
    p.add_argument("--out")
    p.add_argument("--format", choices=["parquet", "json"], default="parquet")
    p.add_argument("--list", action="store_true")
    a = p.parse_args(argv)
    available = _reports()
    if a.list or not a.name:
        print("\n".join(sorted(available)))
        return 0
    if a.name not in available or not a.tables or not a.out:
        p.error("give a known name, --tables and --out (see --list)")

    from .session import get_session
    from .sources.tables import export_json, load

    spark = get_session()
    result = available[a.name](load(spark, a.tables))
    if a.format == "json":
        export_json(result, a.out)
    else:
        result.write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
