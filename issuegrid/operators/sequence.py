"""Stored id sequences, so that an id is never given out twice.

A table's largest id does not tell which ids were given out: the last row may be gone. A
sequence table ``(table_name, last_id)`` keeps the high-water mark beside the tables. An
insert reserves the range behind it (:func:`next_start`) and hands back the sequences with
the mark moved (:func:`advanced`); deletes never move it. Like all changes these are pure:
the caller saves the sequences with the tables of the same change.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PRIMARY_KEYS


def sequences(tables: dict[str, DataFrame], stored: DataFrame | None = None) -> DataFrame:
    """``(table_name, last_id)``: the largest id of every table, or the ``stored`` mark where
    that is larger. An empty table that has no mark starts at 0."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.coalesce(F.max(PRIMARY_KEYS[name]).cast("long"), F.lit(0).cast("long")).alias("last_id"))
             for name, df in tables.items() if name in PRIMARY_KEYS]
    if stored is not None:
        parts.append(stored.select("table_name", F.col("last_id").cast("long").alias("last_id")))
    return functools.reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(F.max("last_id").alias("last_id"))


def next_start(stored: DataFrame, table: str) -> Column:
    """The last id given out to ``table`` (0 without a mark) as a scalar subquery column."""
    return F.coalesce(stored.filter(F.col("table_name") == table).select(F.max("last_id")).scalar(), F.lit(0).cast("long"))


def advanced(stored: DataFrame, table: str, inserted: DataFrame) -> DataFrame:
    """The sequences after ``inserted`` rows got their ids: the mark of ``table`` moves to
    the largest of them, and never back."""
    new = inserted.agg(F.lit(table).alias("table_name"), F.max(PRIMARY_KEYS[table]).cast("long").alias("last_id")).filter(F.col("last_id").isNotNull())
    return stored.select("table_name", "last_id").unionByName(new).groupBy("table_name").agg(F.max("last_id").alias("last_id"))
