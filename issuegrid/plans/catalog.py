"""Registered queries: each operator run over the stand-in tables of one scale.

Every entry is ``fn(spark, sf_dir) -> DataFrame`` and reads whole tables. The
matching DuckDB text for the differential check lives in :mod:`.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixture import fixture_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NO_ORACLE: set[str] = set()


def query(name: str, oracle: bool = True):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fixture_tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if not oracle:
            NO_ORACLE.add(name)
        return fn

    return wrap


# Queries are defined in these modules; importing them fills QUERIES.
from . import q_access, q_changes, q_core, q_io, q_labels, q_maintain, q_pages, q_quality  # noqa: E402,F401
