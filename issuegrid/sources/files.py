"""Listing of stored attachment files.

Uses Spark's ``binaryFile`` source and keeps only ``path``, ``length`` and
``modificationTime``; the ``content`` column is never selected, so file bodies are
not read (the source reads content only when it is required).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """``(path, stored_name, size_bytes, modified_at)`` for every file under ``directory``."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(directory)
    return df.select(
        F.col("path"),
        F.element_at(F.split(F.col("path"), "/"), -1).alias("stored_name"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )
