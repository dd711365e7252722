"""Bounded samples of labelled documents for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of labelled texts that a model is fitted on at most.
TRAIN_BYTES = 64 << 20


def held_out(modulus: int, fold: int) -> Column:
    """Whether a row belongs to the held-out fold: crc32(doc_id as text) mod ``modulus`` = ``fold``.

    A row without doc_id cannot be labelled and counts as not held out.
    """
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, fold: int, rows: int,
                  max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``rows`` labelled documents outside the held-out fold,
    their texts at most ``max_bytes`` long together.

    The sample is the rows with the smallest hash of their doc_id, as many as the bytes allow.
    Rows without label or doc_id are left out; a doc_id with several labels counts as 1 if any
    is; of a doc_id with several texts the smallest is taken (a null text is empty). The sample's ids are broadcast:
    ``rows`` bounds their size and the rows of the running sum.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(modulus, fold))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
             .groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    within = texts.select("doc_id", so_far.alias("bytes")).where(F.col("bytes") <= max_bytes).select("doc_id")
    return texts.join(F.broadcast(within), "doc_id", "left_semi").select("doc_id", "text", "label")
