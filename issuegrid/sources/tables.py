"""Base-table scans with a fixed schema, and the writers.

Tables are stored as one Parquet folder per table (``<dir>/<table>.parquet``).
Reads never infer types: every column is cast to the declared schema once, right
after the scan, so Catalyst still prunes columns and pushes filters to Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCHEMAS, TABLES, not_null_columns


def conform(df: DataFrame, table: str, keep_extra: bool = False) -> DataFrame:
    """Cast ``df`` to the declared schema of ``table``.

    Integer keys stored as BIGINT are narrowed to INT, timestamps read as
    TIMESTAMP_NTZ become session-zone TIMESTAMP. Nullable columns missing from the input
    are added as typed nulls; a missing column that must not be null is an error. Extra
    columns are dropped unless ``keep_extra``.
    """
    present = set(df.columns)
    missing = [c for c in not_null_columns(table) if c not in present]
    if missing:
        raise ValueError(f"{table}: required columns are missing: {', '.join(missing)}")
    cols = [
        (F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in SCHEMAS[table].fields
    ]
    if keep_extra:
        declared = {f.name for f in SCHEMAS[table].fields}
        cols += [F.col(c) for c in df.columns if c not in declared]
    return df.select(*cols)


def load(spark: SparkSession, directory: str, tables: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """Scan ``<directory>/<table>.parquet`` for each table, conformed."""
    return {t: conform(spark.read.parquet(f"{directory}/{t}.parquet"), t) for t in tables}


def register(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Expose tables to SQL users as temp views (``user`` is quoted in SQL)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """S3: add rows to a stored table (new files; existing files untouched)."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace(df: DataFrame, path: str, partition_by: list[str] | None = None,
            sort_within: list[str] | None = None) -> None:
    """Write a table from scratch.

    ``sort_within`` orders rows inside each file (e.g. by ``issue_id`` for the child
    tables) so Parquet row-group min/max statistics prune lookups by key — the
    file-layout stand-in for the reference's secondary indexes.
    """
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_tables(tables: dict[str, DataFrame], directory: str) -> None:
    """Write a whole set of tables to a new directory (the result of a change batch)."""
    layout = {"comment": ["issue_id"], "attachment": ["issue_id"], "worklog": ["issue_id"],
              "issue": ["project_id", "issue_id"]}
    for name, df in tables.items():
        replace(df, f"{directory}/{name}.parquet", sort_within=layout.get(name))


def export_json(df: DataFrame, path: str) -> None:
    """Write documents as JSON lines; null fields are kept, as the API returns them."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def to_json_documents(df: DataFrame) -> DataFrame:
    """S5 (column form): one JSON text per row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("document"))


# Tables whose joins run on ``issue_id``: bucketing them by it co-locates the
# worklog/comment/attachment ⋈ issue joins of A1–A3, A6 and N1.
BUCKET_KEYS = {"issue": "issue_id", "worklog": "issue_id", "comment": "issue_id", "attachment": "issue_id"}


def save_bucketed(tables: dict[str, DataFrame], directory: str, buckets: int, prefix: str = "ig_") -> dict[str, str]:
    """S4 (co-located layout): write the issue-keyed tables bucketed and sorted by
    ``issue_id`` into ``<directory>/<table>`` and register them as catalog tables
    ``<prefix><table>``. Joins between two such tables on ``issue_id`` with the
    same bucket count need no shuffle. Other tables are written as plain Parquet.
    Returns ``{table: catalog name or path}``."""
    out = {}
    for name, df in tables.items():
        path = f"{directory}/{name}"
        key = BUCKET_KEYS.get(name)
        if key:
            (df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
             .option("path", path).saveAsTable(f"{prefix}{name}"))
            out[name] = f"{prefix}{name}"
        else:
            df.write.mode("overwrite").parquet(path)
            out[name] = path
    return out


def load_bucketed(spark: SparkSession, names: dict[str, str]) -> dict[str, DataFrame]:
    """Read tables written by :func:`save_bucketed` (bucketed ones through the
    catalog, so the planner knows their layout)."""
    return {t: (spark.table(n) if t in BUCKET_KEYS else spark.read.parquet(n)) for t, n in names.items()}
