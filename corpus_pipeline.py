"""The corpus pipeline: documents through five stages, each over all that the one before kept.

1. quality: documents that the rule ensemble scores below one half go.
2. near duplicates: of each group of near-duplicates (five-word shingles, a similarity of
   0.8 or more) the document with the smallest doc_id stays.
3. repeated substrings: bytes of 100-byte strings that start earlier are cut out, as far as
   they are whole characters.
4. decontamination: documents that the benchmark contaminates go.
5. encoding: each document's token ids and the text they decode to.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``. ``n_chars`` always counts the text as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuegrid.llm.bpe import round_trip
from issuegrid.llm.decontam import contamination
from issuegrid.llm.minhash import near_duplicates
from issuegrid.llm.quality import fitted, with_statistics
from issuegrid.llm.queries import table, tokenizer_path
from issuegrid.llm.substrings import repeated_substrings
from issuegrid.llm.text import quoted, shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of one half or more.

    The ensemble is fitted on the labelled rows of the ``documents`` table (a bounded
    sample); texts that are null or empty are scored like any other.
    """
    score = fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return with_statistics(docs, *docs.columns).where(score >= 0.5).select("kept.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id.

    Documents without words stay. Rows that share a doc_id and a text are one document and
    stay as often as they come; a doc_id goes with all its rows; rows without doc_id stay.
    """
    gone = near_duplicates(docs, words=5, percent=80).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*quoted(docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes of earlier 100-byte strings. A character only part of whose bytes
    are repeated stays whole; a text that is repeated as a whole becomes empty; null becomes empty."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(*quoted(rest)).alias("rest")) if rest else docs.select("doc_id", "text")
    cut = repeated_substrings(rows, 100, carry=("rest",) if rest else (), whole_characters=True)
    out = cut.select("doc_id", F.col("kept").cast("string").alias("text"), *(F.col(f"rest.{q}") for q in quoted(rest)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*quoted(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate (hit words below a twentieth)."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    clean = contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(rest)).where("not contaminated")
    return clean.select(*(q if c in ("doc_id", "text") else F.col(f"kept.{q}").alias(c) for c, q in zip(docs.columns, quoted(docs.columns), strict=True)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of every document."""
    return round_trip(docs, tokenizer_path("byte_bpe_50k.json")).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("bpe encoding and decoding", encode),
]

#: Trained rules, components and merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and
    read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out, path = stage(spark, docs, sf_dir), shared_path(spark, f"stage{k}")
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
