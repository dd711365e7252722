"""Byte-level text helpers shared by the operators: numpy over Arrow batches.

A batch's text column is viewed as one ``uint8`` array plus offsets, cut into
chunks of a few MB, so the memory of a task does not depend on the batch or on
how long single texts are (one text longer than a chunk forms its own chunk).
Null texts count as empty.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

CHUNK_BYTES = 4 << 20
_ODD = 0x9E3779B97F4A7C15          # odd multiplier of the prefix hash, and its inverse
_INV = pow(_ODD, -1, 1 << 64)
_U = np.uint64


def byte_set(pattern_bytes) -> np.ndarray:
    """256 booleans: which byte values are in ``pattern_bytes``."""
    t = np.zeros(256, bool)
    t[list(pattern_bytes)] = True
    return t


#: Words ``[^\x20\x09-\x0D]+`` (white space separates).
SPACED_WORD = ~byte_set([0x20, *range(0x09, 0x0E)])
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text (letters, digits, non-ASCII).
PLAIN_WORD = byte_set([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BYTE_VALUE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | _U(1)


def text_chunks(batch: pa.RecordBatch, column: str = "text",
                max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of successive chunks of a batch."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    _, off_buf, data_buf = col.buffers()
    offsets = np.frombuffer(off_buf, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(col):
        end = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        end = min(max(end, first + 1), len(col))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first word of each text)`` of the words of a chunk; ``word[b]`` says
    whether byte ``b`` belongs to a word. Words never cross texts."""
    inside = word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9) + _U(seed * 0x632BE59BD9B4E019 % (1 << 64))
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_POWERS = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.ones(max(n, 1 << 20), np.uint64)
            have[1:] = base
            np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``H`` with :func:`span_hash` telling any span's hash from two entries of it."""
    h = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):                 # in place: one array of the data's length
        np.take(_BYTE_VALUE, data, out=h[1:])
        h[1:] *= powers(_ODD, len(data))
        np.cumsum(h[1:], out=h[1:])
    return h


def quoted(names) -> list[str]:
    """Column names as expressions, also with a dot in them."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans ``[start, end)``; equal spans hash alike wherever they are."""
    with np.errstate(over="ignore"):
        return mixed((h[ends] - h[starts]) * powers(_INV, len(h))[starts] + (ends - starts).astype(np.uint64))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder of ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return os.path.join(base, f"llm-{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: cuts the lineage,
    survives lost executors, and is compressed."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the folder behind a :func:`saved` table that is no longer read."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if path.getName().startswith("llm-"):
            path.getFileSystem(conf).delete(path, True)
