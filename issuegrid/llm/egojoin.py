"""Near-duplicate vectors by an epsilon grid order join (operator 6).

Cosine >= c means a distance of at most ``sqrt(2 - 2c)`` between unit vectors. Vectors are
turned so that the leading coordinates are their principal directions and sorted by the
grid cells of that width along them: the epsilon grid order. The sorted sequence is cut
into blocks; two blocks are compared only if their bounds on the leading coordinates come
that close, and inside a task two intervals are halved and skipped the same way until a
matrix product settles what is left, in double precision. Vectors of different lengths are
never linked: every length has its own directions, order and blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import saved

LEADING = 8              # principal coordinates that the order and the bounds use
BLOCK, LEAF = 4096, 512  # vectors of a block, and of an interval that is multiplied out


def _by_length(column):
    """``(length, places, vectors)`` of an Arrow list column: its vectors as rows of doubles, one
    length at a time in the order in which the lengths first occur."""
    size = np.asarray(column.value_lengths())
    flat, start = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
    widths, first = np.unique(size, return_index=True)
    for w in widths[np.argsort(first)].tolist():
        rows = np.flatnonzero(size == w)
        yield w, rows, flat[start[rows][:, None] + np.arange(w)[None, :]]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)                  # neither overflow nor underflow in the norm
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _principal(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions of the unit vectors of each length, from sums made in the
    tasks; one length's sums are held at a time, which suits rows in the order of lengths."""

    def run(batches):
        width, total = 0, None

        def sums():
            return pa.RecordBatch.from_arrays([pa.array(np.full(total.size, width, np.int32)), pa.array(np.arange(total.size, dtype=np.int32)),
                                               pa.array(total.ravel())], ["w", "k", "s"])

        for batch in batches:
            for w, _, v in _by_length(batch.column(0)):
                if w != width:
                    if width:
                        yield sums()
                    width, total = w, np.zeros((w + 1, w + 1))
                u = np.concatenate([_unit(v), np.ones((len(v), 1))], 1)
                total += u.T @ u
        if width:
            yield sums()

    def axes(table):
        width = table.column("w")[0].as_py()
        total = np.zeros((width + 1) ** 2)
        total[table.column("k").to_numpy()] = table.column("s").to_numpy()
        total = total.reshape(width + 1, width + 1)
        n = max(total[-1, -1], 1)
        mean = total[-1, :-1] / n
        _, out = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
        return pa.table({"w": pa.array([width], pa.int32()), "axes": pa.array([np.ascontiguousarray(out[:, ::-1][:, :LEADING]).tobytes()])})

    sums = vectors.mapInArrow(run, "w int, k int, s double").groupBy("w", "k").agg(F.sum("s").alias("s"))
    return {r.w: np.frombuffer(r.axes).reshape(r.w, -1) for r in sums.groupBy("w").applyInArrow(axes, "w int, axes binary").collect()}


def _close(lo_a, hi_a, lo_b, hi_b, eps: float) -> bool:
    """Whether boxes may hold points within ``eps`` (a little more, for rounding)."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap) <= eps * eps + 1e-9


def join_intervals(u: np.ndarray, lead: np.ndarray, a: slice, b: slice, cosine: float, eps: float):
    """``(i, j)`` arrays of the pairs with cosine at least ``cosine`` between two intervals of the
    epsilon grid order (``i < j`` if they are one interval), by recursion over their halves."""
    if a.start >= a.stop or b.start >= b.stop or not _close(lead[a].min(0), lead[a].max(0), lead[b].min(0), lead[b].max(0), eps):
        return
    n, m = a.stop - a.start, b.stop - b.start
    if n <= LEAF and m <= LEAF:
        i, j = np.nonzero(u[a] @ u[b].T >= cosine)
        i, j = i + a.start, j + b.start
        keep = i < j if a == b else slice(None)
        yield i[keep], j[keep]
        return
    halves = lambda s: (slice(s.start, (s.start + s.stop) // 2), slice((s.start + s.stop) // 2, s.stop))
    if a == b:
        x, y = halves(a)
        pairs = [(x, x), (x, y), (y, y)]
    elif n >= m:
        pairs = [(x, b) for x in halves(a)]
    else:
        pairs = [(a, y) for y in halves(b)]
    for x, y in pairs:
        yield from join_intervals(u, lead, x, y, cosine, eps)


def near_vectors(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``embeddings (vec_id, embedding)``.

    A vector that is null, zero, empty, or holds null or non-finite components has no links;
    it is its own component. Others are linked to vectors of their length. Equal vectors are one point with a weight: a row's ``n_links`` counts the
    other rows of its own point and all rows of linked points. Rows repeated under one
    vec_id count as vectors of their own. A row without vec_id is counted as a link by
    others, but lends no id to a component (null if no other row has one). Other columns
    are ignored, an empty table gives an empty result.
    """
    spark, eps = embeddings.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0.0)
    rows = rows.withColumn("point", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("v")))
    points = rows.where("point is not null").groupBy("point", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("id"))
    points = saved(points.sortWithinPartitions(F.size("v")), "points")
    axes = _principal(points.select("v"))
    shared = spark.sparkContext.broadcast(axes)

    def cells(batches):
        for batch in batches:
            for w, at, v in _by_length(batch.column(1)):
                lead = _unit(v) @ shared.value[w]
                cell = np.floor(lead / eps).astype(np.int64) if eps else np.round(lead * 1e9).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(np.full(len(at), w, np.int32)), pa.array(list(cell), pa.list_(pa.int64()))],
                                                 ["point", "v", "n", "id", "w", "cell"])

    # The epsilon grid order of each length: by cells, coordinate by coordinate.
    order = saved(points.mapInArrow(cells, "point bigint, v array<double>, n bigint, id bigint, w int, cell array<bigint>").orderBy("w", "cell", "point"), "order")

    def blocks(batches):
        held, count, width = [], 0, 0

        def block(held):
            point, v, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            u = _unit(v)
            lead = u @ shared.value[width]
            return pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), pa.array([int(point[0])], pa.int64()), pa.array([point.tobytes()]), pa.array([n.tobytes()]),
                 pa.array([u.tobytes()]), pa.array([lead.min(0)]), pa.array([lead.max(0)])], ["w", "block", "point", "n", "u", "lo", "hi"])

        for batch in batches:
            for w, at, v in _by_length(batch.column(1)):
                if w != width:                                # a block holds vectors of one length
                    if held:
                        yield block(held)
                    held, count, width = [], 0, w
                rest = (batch.column(0).to_numpy()[at], v, batch.column(2).to_numpy()[at])
                while len(rest[0]):
                    take = min(BLOCK - count, len(rest[0]))
                    held.append(tuple(x[:take] for x in rest))
                    rest, count = tuple(x[take:] for x in rest), count + take
                    if count == BLOCK:
                        yield block(held)
                        held, count = [], 0
        if held:
            yield block(held)

    cut = saved(order.select("point", "v", "n").mapInArrow(
        blocks, "w int, block bigint, point binary, n binary, u binary, lo array<double>, hi array<double>"), "blocks")
    # Blocks of one length meet in the cells of the first coordinate that their bounds, widened by eps, touch;
    # then the bounds on all leading coordinates decide.
    box = cut.select("w", "block", "lo", "hi")
    step = max(eps, 1e-3)
    touch = lambda lo, hi: F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step)))
    left = box.select("w", F.col("block").alias("x"), F.col("lo").alias("lo_x"), F.col("hi").alias("hi_x"), touch(F.col("lo")[0], F.col("hi")[0] + eps + 1e-9).alias("c"))
    right = box.select("w", F.col("block").alias("y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"), touch(F.col("lo")[0], F.col("hi")[0] + eps + 1e-9).alias("c"))
    gaps = F.transform(F.arrays_zip("lo_x", "hi_x", "lo_y", "hi_y"), lambda z: F.greatest(F.lit(0.0), z["lo_x"] - z["hi_y"], z["lo_y"] - z["hi_x"]))
    pairs = left.join(right, ["w", "c"]).where("x <= y").select("w", "x", "y", gaps.alias("gaps")).where(
        F.aggregate("gaps", F.lit(0.0), lambda s, g: s + g * g) <= eps * eps + 1e-9).select("w", "x", "y").distinct()
    body = cut.select("block", F.struct("point", "n", "u").alias("body"))
    work = pairs.join(body.select(F.col("block").alias("x"), F.col("body").alias("bx")), "x").join(
        body.select(F.col("block").alias("y"), F.col("body").alias("by")), "y")

    def compare(batches):
        for batch in batches:
            for width, x, y, bx, by in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                sides = [bx] if x == y else [bx, by]
                point = np.concatenate([np.frombuffer(s["point"], np.int64) for s in sides])
                n = np.concatenate([np.frombuffer(s["n"], np.int64) for s in sides])
                u = np.concatenate([np.frombuffer(s["u"]).reshape(-1, width) for s in sides])
                lead, first = u @ shared.value[width], len(np.frombuffer(sides[0]["point"], np.int64))
                a, b = slice(0, first), slice(0, first) if x == y else slice(first, len(point))
                links, label = np.zeros(len(point), np.int64), np.arange(len(point))
                found = []
                for i, j in join_intervals(u, lead, a, b, cosine, eps):
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    found.append((i, j))
                i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
                while True:                                   # smallest place reachable by the piece's links
                    low = label.copy()
                    np.minimum.at(low, i, label[j])
                    np.minimum.at(low, j, label[i])
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(point[hit]), pa.array(point[label[hit]]), pa.array(links[hit])], ["a", "b", "links"])

    # One row a point and piece of work: how many links, and a link to the piece's smallest one.
    linked = saved(work.select("w", "x", "y", "bx", "by").mapInArrow(compare, "a bigint, b bigint, links bigint"), "linked")
    ends = components(linked.select("a", "b")).select(F.col("id").alias("point"), "component")
    counts = linked.groupBy(F.col("a").alias("point")).agg(F.sum("links").alias("links"))
    grouped = points.select("point", "n", "id").join(counts, "point", "left").join(ends, "point", "left").select(
        "point", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "point").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    of_point = grouped.join(smallest, "component").select("point", "n_links", "component_id")
    out = rows.select("vec_id", "point").join(of_point, "point", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.when(F.col("point").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
