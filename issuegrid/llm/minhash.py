"""Near-duplicate texts by one-permutation hashing (operator 2).

1. One pass over the texts gives each document its shingle-set size, a 128-bit
   fingerprint of the set and a one-permutation signature (``bins`` minima of one hash;
   an empty bin copies a filled bin drawn by a hash of its number: optimal densification).
2. Equal sets collapse to their smallest doc_id, so a group of copies is one class.
3. The classes' signatures are cut into ``bands``; equal band values form a bucket.
   Each bucket gives a star: its centre against every other member, not all pairs.
4. Candidates are confirmed on the full sets; confirmed links form components.
5. What the stars leave open - members of one bucket that are still in different
   components - is compared on the full sets, block by block inside tasks, so no link
   hangs on which member was the centre.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import LOWER, SPACED_WORD, dropped, mixed, prefix_hash, saved, span_hash, text_chunks, word_spans

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
BLOCK, BLOCK_SHINGLES = 2048, 500_000    # members, and shingles of theirs, that one block of an open cluster has at most
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: text ``i``'s distinct shingle hashes, ascending, are
    ``hashes[bounds[i]:bounds[i + 1]]``. A text of fewer words is one shingle, of none no shingle."""
    starts, ends, first = word_spans(data, offsets, SPACED_WORD)
    h = span_hash(prefix_hash(LOWER[data]), starts, ends)
    n_words = np.diff(first)
    size = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[:-1][doc]
    left = first[1:][doc] - at                                  # words from the shingle's first to the text's end
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        nxt = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else out
        with np.errstate(over="ignore"):
            out = np.where(k < left, mixed(out + nxt, k + 1), out)
    order = np.argsort(out, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    doc, out = doc[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    doc, out = doc[new], out[new]
    return out, np.searchsorted(doc, np.arange(len(size) + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One-permutation signatures, densified: a row of :data:`BINS` values for each set (zeros for none)."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    slot = doc * BINS + (hashes >> _U(64 - 7)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]                           # ascending: a bin's first hash is its minimum
    sig, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    sig[slot[first]], filled[slot[first]] = hashes[first], True
    sig, filled = sig.reshape(n, BINS), filled.reshape(n, BINS)
    out = sig.copy()
    rows, cols = np.nonzero(~filled & (np.diff(bounds) > 0)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        pick = (mixed(cols.astype(np.uint64), attempt) >> _U(64 - 7)).astype(np.int64)
        hit = filled[rows, pick]
        out[rows[hit], cols[hit]] = sig[rows[hit], pick[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, buckets)`` of every row; ``set_a, set_b`` tell the
    set, ``buckets`` are the keys of its signature's bands."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                hashes, bounds = shingle_sets(data, offsets, words)
                n = np.diff(bounds)
                csum = []
                with np.errstate(over="ignore"):
                    for seed in (101, 102):
                        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes, seed))])
                        csum.append((c[bounds[1:]] - c[bounds[:-1]]).astype(np.int64))
                    sig = signatures(hashes, bounds)
                    bands = np.zeros((len(n), BANDS), np.uint64)
                    for r in range(ROWS):
                        bands = mixed(bands + sig.reshape(len(n), BANDS, ROWS)[:, :, r], r + 7)
                    bands += np.arange(BANDS, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(csum[0]), pa.array(csum[1]),
                    pa.ListArray.from_arrays(np.arange(0, len(n) * BANDS + 1, BANDS, dtype=np.int32),
                                             pa.array(bands.astype(np.int64).ravel()))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "buckets"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, buckets array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets reach ``percent`` of their union."""

    def run(batches):
        last, kept = {}, []

        def of(i, text):                                         # pairs come sorted by a: its set is made once
            if i not in last:
                last.clear()
                raw = text.encode()
                last[i] = shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), words)[0]
            return last[i]

        for batch in batches:
            kept = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = of(a, ta)
                raw = tb.encode()
                y = shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), words)[0]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()),
                                              pa.array([k[1] for k in kept], pa.int64())], ["a", "b"])

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").sortWithinPartitions("a").mapInArrow(run, "a bigint, b bigint")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``(id, set)``: the shingle hashes of each text, as bytes."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                hashes, bounds = shingle_sets(data, offsets, words)
                raw = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(raw, pa.binary())], ["id", "set"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, set binary")


def _common(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every set of ``rows`` with every set of ``cols``, as
    products of the sets' incidence matrices, some thousand shingles at a time."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[code] > 1
    of, code = of[keep], shared[code[keep]]
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, int(shared[-1]) + 1 if len(shared) else 0, 2048):
        a, b = np.searchsorted(code, [lo, lo + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[of[a:b], code[a:b] - lo] = 1
        out += part[rows] @ part[cols].T
    return out


def _open_links(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that the stars left in different components.

    Members connected by buckets form a cluster; a cluster is dealt into blocks of bounded
    size, and a task compares the full sets of two blocks at a time by matrix products.
    Nothing is emitted for a pair but the links that join two components.
    """
    low = left.groupBy("bucket").agg(F.min("id").alias("b"))
    cluster = components(left.join(low, "bucket").select(F.col("id").alias("a"), "b")).withColumnRenamed("component", "cluster")
    members = left.select("id", "component", "n").distinct().join(cluster, "id")
    size = members.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK)).cast("int").alias("blocks"))
    dealt = members.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Every two blocks (x <= y) are one piece of work; a member goes to the pieces of its block.
    pieces = dealt.join(sets, "id").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.struct("block", "id", "component", "set").alias("m"))
    pieces = pieces.groupBy("cluster", "x", "y").agg(F.collect_list("m").alias("ms"))

    def run(batches):
        for batch in batches:
            for x, y, ms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ms = ms.values
                block, ids, label = (ms.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                label, found = label.copy(), []
                sets = [np.frombuffer(b, np.uint64) for b in ms.field(3).to_pylist()]
                rows, cols = np.flatnonzero(block == x), np.flatnonzero(block == y)
                n = np.array([len(s) for s in sets])
                both = _common(sets, rows, cols)
                linked = 100 * both >= percent * (n[rows][:, None] + n[cols][None, :] - both)
                for k in np.flatnonzero(linked.any(1)):
                    i, js = rows[k], cols[linked[k]]
                    while len(js := js[label[js] != label[i]]):         # one link a component that joins
                        found.append((ids[i], ids[js[0]]))
                        label[label == label[js[0]]] = label[i]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return pieces.select("x", "y", "ms").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs (doc_id, text)``.

    Documents with ``100 * |A n B| >= percent * |A u B|`` are linked; ``component_id`` is the
    smallest doc_id reachable, ``kept`` says that the row is it. A null text has no words; a
    document without words has an empty set, is linked with nothing and is its own component.
    Rows repeated under one doc_id are copies of each other; different texts under one doc_id
    are one document, linked as the smallest of its texts is. A row without doc_id is linked
    like any other for the sake of its neighbours' links only if another row has its set;
    its ``component_id`` is that of its set (null if no row with an id has it), ``kept`` is false.
    Other columns are ignored; an empty table gives an empty result.
    """
    prints = saved(fingerprints(docs, words), "prints")
    classes = prints.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(
        F.min("doc_id").cast("bigint").alias("id"), F.first("buckets").alias("buckets"))
    classes = saved(classes, "classes")
    listed = classes.select(F.explode("buckets").alias("bucket"), "id", F.col("n_shingles").alias("n"))
    centre = F.min(F.struct(F.xxhash64("id").alias("o"), "id", "n")).alias("c")    # the same text in many buckets
    shared = listed.groupBy("bucket").agg(F.count("*").alias("k"), centre).where("k > 1")
    members = saved(listed.join(shared.select("bucket", F.col("c.id").alias("centre"), F.col("c.n").alias("m")), "bucket"), "members")
    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    stars = members.where((F.col("id") != F.col("centre")) & near).select(
        F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    ids = members.select("id").distinct()
    texts = saved(docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), "text")
                  .join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts")
    links = saved(confirmed(stars, texts, words, percent), "links")
    found = components(links)

    labelled = members.select("bucket", "id", "n").join(found, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    still = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    left = saved(labelled.join(still.select("bucket"), "bucket", "left_semi"), "left")
    more = saved(_open_links(left, _sets(texts.join(left.select("id").distinct(), "id", "left_semi"), words), percent), "more")
    # What the open links join are components: only those move.
    if not more.isEmpty():
        of = lambda side: F.col(f"{side}.component")
        label = labelled.select("id", "component").distinct()
        moved = more.join(label.alias("x"), F.col("a") == F.col("x.id")).join(label.alias("y"), F.col("b") == F.col("y.id"))
        moved = components(moved.select(of("x").alias("a"), of("y").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("to"))
        found = label.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    ends = found

    of_class = classes.select("set_a", "set_b", "n_shingles", "id").join(ends, "id", "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = prints.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    dropped(texts)
    dropped(left)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
