"""Connected components of an edge table, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id on an edge ``(a, b)``; component = smallest reachable id.

    Large-star / small-star rounds: every round hangs ids below smaller ones, and the
    number of edges never grows. Minima are aggregated map-side and the joins are plain
    equi-joins, so a hub's edges are split by the skew join. Each round is written to the
    shared folder; the loop ends when the edges are stars: every id hangs below one id,
    which hangs below none. No edges: no rows.
    """
    e, written = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi"), None
    while True:
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = e.withColumnRenamed("lo", "u").join(least, "u").select(F.col("m").alias("lo"), "hi").where("lo < hi")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("x"), F.explode(F.array("lo", "hi")).alias("y"))
        e = saved(small.where("x < y").select(F.col("x").alias("lo"), F.col("y").alias("hi")).distinct(), "edges")
        if written is not None:
            dropped(written)
        written = e
        ends = e.select(F.col("lo").alias("id"), F.lit(0).alias("below")).unionAll(e.select(F.col("hi").alias("id"), F.lit(1).alias("below")))
        # An id that hangs below several ids, or below one while others hang below it.
        if ends.groupBy("id").agg(F.sum("below").alias("b"), F.min("below").alias("top")).where("b > 1 or b > 0 and top = 0").isEmpty():
            break
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(
        e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
