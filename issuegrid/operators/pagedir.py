"""Pages at any depth (P1 to P8): a stored order and a directory of its ranges.

``OFFSET n`` brings ``n`` rows into the task that cuts the page. Here the rows are written
once in page order: cut into ranges at sampled bounds of (parent, order columns), one folder
a range, with a directory that holds for every range and parent how many of the parent's
rows the range has and how many lie before it. A page reads the directory and the one or
two ranges it lies in, however deep it is; no task handles more than a range.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .paging import DEFAULT_LIMIT, sort_columns

ROWS_PER_RANGE = 1_000_000


@dataclass(frozen=True)
class PageDirectory:
    """A stored page order: ``path``, its ``order`` and the ``parent`` column (None: one list)."""

    path: str
    order: list[tuple[str, bool]]
    parent: str | None

    def _ranges(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(os.path.join(self.path, "directory"))

    def _of(self, spark: SparkSession, parent) -> DataFrame:
        ranges = self._ranges(spark)
        return ranges.where(F.col("parent").eqNullSafe(F.lit(parent))) if self.parent else ranges

    def rows_of(self, spark: SparkSession, parent=None) -> int:
        """How many rows the parent has (from the directory)."""
        return self._of(spark, parent).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, spark: SparkSession, parent=None, skip: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Rows ``skip + 1 .. skip + limit`` of the parent's list, in page order: the same as
        ``paging.page`` over its rows. An unknown parent or a page behind the end is empty."""
        if skip < 0 or limit < 0:
            raise ValueError("skip and limit must be >= 0")
        rows = spark.read.parquet(os.path.join(self.path, "rows"))
        columns = [c for c in rows.columns if c != "range_no"]
        near = (self._of(spark, parent).where((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip))
                .select("range_no", "before").collect())          # at most limit + 1 ranges
        rows = rows.where(F.col("range_no").isin([r.range_no for r in near]))     # prunes folders
        if self.parent:
            rows = rows.where(F.col(self.parent).eqNullSafe(F.lit(parent)))
        before = F.coalesce(*[F.when(F.col("range_no") == r.range_no, F.lit(r.before)) for r in near], F.lit(0))
        place = F.row_number().over(Window.partitionBy("range_no").orderBy(*sort_columns(self.order))) + before
        return (rows.withColumn("__place", place).where((F.col("__place") > skip) & (F.col("__place") <= skip + limit))
                .orderBy("__place").select(*columns))


def build(df: DataFrame, order: list[tuple[str, bool]], path: str, parent: str | None = None,
          rows_per_range: int = ROWS_PER_RANGE) -> PageDirectory:
    """Write ``df`` in page order under ``path`` with its directory.

    The order must end with a unique column, so that equal values cannot fill a range
    without bound; a parent with a third of all rows is many ranges. Range sizes follow
    sampled bounds, places in the list are exact counts."""
    spark = df.sparkSession
    keys = ([F.col(parent).asc_nulls_first()] if parent else []) + sort_columns(order)
    total = df.count()
    ranges = max(1, -(-total // rows_per_range))
    (df.repartitionByRange(ranges, *keys).withColumn("range_no", F.spark_partition_id())
     .write.mode("overwrite").partitionBy("range_no").parquet(os.path.join(path, "rows")))
    if not total:                                                 # partitioned tables keep no schema without rows
        df.withColumn("range_no", F.lit(0)).write.mode("overwrite").parquet(os.path.join(path, "rows"))
    held = F.col(parent) if parent else F.lit(0)
    counts = (spark.read.schema(df.schema.add("range_no", "integer")).parquet(os.path.join(path, "rows"))
              .groupBy(held.alias("parent"), "range_no").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("parent").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    (counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
     .write.mode("overwrite").parquet(os.path.join(path, "directory")))
    return PageDirectory(path, order, parent)
