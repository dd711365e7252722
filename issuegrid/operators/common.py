"""Join and aggregation helpers shared by the operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import HOURS_SUM


def lookup(fact: DataFrame, dim: DataFrame, fact_key: str | list[str], dim_key: str | list[str],
           columns: dict[str, str], how: str = "left", spread_by: str | None = None) -> DataFrame:
    """Attach ``columns`` ({dim column: output name}) of ``dim`` to ``fact``.

    An equi-join on ``fact_key == dim_key`` (one column or a list). The planner
    (AQE) picks broadcast or sort-merge from measured sizes; no broadcast is
    forced because dimension sizes grow with the data.

    For left joins with ``spread_by`` (the fact's primary key), rows whose key
    is null — the usual hot key: worklogs of deleted users, issues without a
    parent — are not sent to one task. The join runs on one struct key:
    ``(0, key…)`` for the dimension and for fact rows with a full key, and
    ``(odd 64-bit hash of spread_by, key…)`` for fact rows with a null in the
    key. The first field never matches for those rows (they could not match
    anyway) and spreads them over every shuffle partition. The dimension side
    is a real column expression, so the optimizer cannot fold it away.
    """
    fks = [fact_key] if isinstance(fact_key, str) else list(fact_key)
    dks = [dim_key] if isinstance(dim_key, str) else list(dim_key)
    right = dim.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(dks)],
                       *[F.col(c).alias(a) for c, a in columns.items()])
    if how == "left" and spread_by is not None:
        types = [right.schema[f"__k{i}"].dataType for i in range(len(dks))]
        any_null = functools.reduce(lambda a, b: a | b, [F.col(f).isNull() for f in fks])
        tag = F.when(any_null, F.xxhash64(F.col(spread_by)).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
        left = fact.withColumn("__jk", F.struct(tag.alias("t"), *[F.col(f).cast(types[i]).alias(f"k{i}")
                                                                   for i, f in enumerate(fks)]))
        right = right.withColumn("__jk", F.struct(F.lit(0).cast("long").alias("t"),
                                                  *[F.col(f"__k{i}").alias(f"k{i}") for i in range(len(dks))]))
        out = left.join(right, left["__jk"] == right["__jk"], "left")
        return out.drop("__jk", *[f"__k{i}" for i in range(len(dks))])
    cond = functools.reduce(lambda a, b: a & b, [fact[f] == right[f"__k{i}"] for i, f in enumerate(fks)])
    out = fact.join(right, cond, how)
    return out.drop(*[f"__k{i}" for i in range(len(dks))])


def hours_sum(col: str | Column) -> Column:
    """Sum of hours as DECIMAL(18,2); no rows gives null (callers zero-fill)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c).cast(HOURS_SUM)


def zero_hours() -> Column:
    return F.lit(0).cast(HOURS_SUM)


def restrict(df: DataFrame, keys: DataFrame | None, key: str) -> DataFrame:
    """Keep rows whose ``key`` appears in ``keys`` (a left-semi join); all rows if None."""
    if keys is None:
        return df
    k = keys.select(F.col(keys.columns[0] if key not in keys.columns else key).alias(key))
    return df.join(k, key, "left_semi")
