"""Writing attachment bodies into a file store, one file per row.

Used to lay down a store from a table (e.g. web pages as uploaded files). Each
task writes its own rows through ``pyarrow.fs``, so the target may be a local,
HDFS or object-store URI.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(df: DataFrame, directory: str, name_col: str, body_col: str) -> DataFrame:
    """Write ``body_col`` (text or bytes) of every row to ``<directory>/<name_col>``.

    Returns ``(stored_name, size_bytes)`` per written file (evaluate it to write).
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(directory)
        fs.create_dir(root, recursive=True)
        for pdf in batches:
            sizes = []
            for name, body in zip(pdf["n"], pdf["b"]):
                data = body.encode("utf-8") if isinstance(body, str) else bytes(body or b"")
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"stored_name": pdf["n"], "size_bytes": pd.Series(sizes, dtype="int64")})

    src = df.select(F.col(name_col).alias("n"), F.coalesce(F.col(body_col), F.lit("")).alias("b"))
    return src.mapInPandas(write, "stored_name string, size_bytes long")
