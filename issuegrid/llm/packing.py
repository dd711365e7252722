"""Packing of token ids into fixed-length rows (operator 8).

Documents are cut losslessly into segments of at most one row and packed by best fit
decreasing: the longest segment first, into the row with the least room that still holds
it. The row is found by a segment tree over the capacities, which tells the smallest
capacity of at least a given size that some row has. A task packs block after block of a
bounded number of tokens, so nothing is shuffled and no group outgrows a task.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinary import ordinary_encoder
from .text import text_chunks

ROW_TOKENS = 2048
BLOCK_TOKENS = 2_000_000     # tokens that are packed together at most (and one document more)
PADDING = 0


class Capacities:
    """Rows by the room they have left, with a segment tree over the rooms 0..``size``."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.leaves
        while k and not self.some[k]:
            self.some[k] = True
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """``(room, row)`` with the smallest room of at least ``need``, taken out; or None."""
        k = need + self.leaves
        if not self.some[k]:
            while k > 1 and not (k % 2 == 0 and self.some[k + 1]):   # up, until a right neighbour has rows
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:                                  # down to its leftmost leaf with rows
                k = 2 * k if self.some[2 * k] else 2 * k + 1
        room = k - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            while k:
                self.some[k] = k < self.leaves and (self.some[2 * k] or self.some[2 * k + 1])
                if self.some[k]:
                    break
                k >>= 1
        return room, row


def best_fit_decreasing(sizes: np.ndarray, size: int) -> list[list[int]]:
    """The segments (by number) of each row; every ``sizes`` entry lies in 1..``size``."""
    free, rows = Capacities(size), []
    for k in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[k])
        found = free.take(n)
        if found is None:
            rows.append([k])
            room, row = size, len(rows) - 1
        else:
            room, row = found
            rows[row].append(k)
        if room > n:
            free.add(room - n, row)
    return rows


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """An encoder of a tiktoken rank file (special tokens' strings are ordinary text)."""
    with open(path, "rb") as f:
        return ordinary_encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _packed(block: list[tuple[int | None, np.ndarray]], size: int):
    """Rows ``(ids, cu_seqlens, positions, doc_ids, offsets)`` of one block of documents."""
    segments = [(d, at, ids[at:at + size]) for d, ids in block for at in range(0, len(ids), size)]
    for row in best_fit_decreasing(np.array([len(s[2]) for s in segments], np.int64), size):
        parts = [segments[k] for k in row]
        ids, positions = np.full(size, PADDING, np.uint32), np.zeros(size, np.uint32)
        ends = np.cumsum([0, *(len(p[2]) for p in parts)])
        for p, a, b in zip(parts, ends[:-1], ends[1:], strict=True):
            ids[a:b], positions[a:b] = p[2], np.arange(b - a)
        yield ids, ends, positions, [p[0] for p in parts], [p[1] for p in parts]


def packed_rows(docs: DataFrame, path: str, size: int = ROW_TOKENS) -> DataFrame:
    """Packed rows of all texts of ``docs (doc_id, text)``, tokenized by the rank file ``path``.

    Columns: ``seq_id`` (unique), ``ids`` (``size`` ids as little-endian uint32, zero padding
    at the end), ``cu_seqlens`` (0 and the ends of the row's segments), ``positions`` (uint32:
    each token's place in its segment, beginning at 0 anew), ``doc_ids`` and ``offsets`` (the
    segments' documents and first tokens), ``n_tokens``. A document longer than a row is cut
    into rows' lengths, nothing is dropped. Null and empty texts have no tokens and are in
    no row; repeated rows are packed each; a null doc_id stays null; other columns are
    ignored; an empty table gives no rows. Very long runs of white space are tokens like others.
    """

    def run(batches):
        encode, block, held = encoder(path), [], 0

        def flush():
            rows = list(_packed(block, size))
            for k in range(0, len(rows), 256):
                some = rows[k:k + 256]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0].tobytes() for r in some], pa.binary()), pa.array([r[1] for r in some], pa.list_(pa.int32())),
                    pa.array([r[2].tobytes() for r in some], pa.binary()), pa.array([r[3] for r in some], pa.list_(pa.int64())),
                    pa.array([r[4] for r in some], pa.list_(pa.int64())), pa.array([int(r[1][-1]) for r in some], pa.int64())],
                    ["ids", "cu_seqlens", "positions", "doc_ids", "offsets", "n_tokens"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, _, data, offsets in text_chunks(batch):
                raw = data.tobytes()
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    if a < b:
                        block.append((ids[i + k], encode(raw[a:b].decode("utf-8", "replace"))))
                        held += len(block[-1][1])
                        if held >= BLOCK_TOKENS:
                            yield from flush()
                            block, held = [], 0
        if block:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "ids binary, cu_seqlens array<int>, positions binary, doc_ids array<bigint>, offsets array<bigint>, n_tokens bigint")
    return rows.select(F.monotonically_increasing_id().alias("seq_id"), "*")


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: one row a sequence, the id matrix row by row."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
