"""Source divergence audit (operator 13).

How far the term distributions of a language's sources lie apart, and which terms set a
source off from its language. The differences are summed in a three-dimensional cube: one
cell for every (group block, group block, term block) of a language. A group block's slice
of a term block is replicated to the cells that need it, a cell sums the differences of all
its pairs of groups over its terms, and the partial sums are reduced along the term axis.
A cell holds at most two slices of ``GROUP_BLOCK`` groups by ``TERM_BLOCK`` terms, whatever
the corpus; blocks are dealt by hash, so no window or group sees a whole language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import CHUNK_BYTES, LOWER, byte_set, saved, text_chunks, word_spans

LEAST_DOCS = 30        # documents of a language that hold a kept term at least
TOP_TERMS = 50         # ranks that part ``term`` reports
GROUP_BLOCK = 32       # groups of a block, on average
TERM_BLOCK = 1024      # terms of a block, on average
SCALE = 1_000_000_000  # of the smoothed shares
PRIOR = 5              # added to every count

#: Terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: letters and everything beyond ASCII.
TERM = byte_set([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(distinct terms, number of each occurrence's term, its text)`` of a chunk, lower-cased."""
    starts, ends, first = word_spans(data, offsets, TERM)
    body = LOWER[data[TERM[data]]]
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(body)]).dictionary_encode()
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return terms.dictionary, terms.indices.to_numpy(), texts


def _pieces(data: np.ndarray):
    """A long text cut into pieces of about ``CHUNK_BYTES`` where no term is cut."""
    at = 0
    while at < len(data):
        end = at + CHUNK_BYTES
        while end < len(data):                       # the next byte that no term holds
            gaps = np.flatnonzero(~TERM[data[end:end + CHUNK_BYTES]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += CHUNK_BYTES
        yield data[at:end]
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of every term and documents that hold it.

    Null lang, source and text count as ''. Counted chunk by chunk (a longer text piece by
    piece) before anything is shuffled.
    """

    def run(batches):
        for batch in batches:
            lang, source = (batch.column(k).cast(pa.large_string()).fill_null("").dictionary_encode() for k in (0, 1))
            width = len(source.dictionary)
            group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()

            def rows(groups, terms, n, held, lang=lang, source=source, width=width):
                return pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(groups // width)).cast(pa.string()), source.dictionary.take(pa.array(groups % width)).cast(pa.string()),
                     terms.cast(pa.string()), pa.array(n, pa.int64()), pa.array(held, pa.int64())], ["lang", "source", "term", "n", "docs"])

            for i, j, data, offsets in text_chunks(batch):
                if len(data) > CHUNK_BYTES:           # one long text
                    seen = []
                    for piece in _pieces(data):
                        terms, codes, _ = _occurrences(piece, np.array([0, len(piece)]))
                        seen.append(terms)
                        yield rows(np.full(len(terms), group[i]), terms, np.bincount(codes, minlength=len(terms)), np.zeros(len(terms), np.int64))
                    seen = pa.concat_arrays(seen).unique()
                    yield rows(np.full(len(seen), group[i]), seen, np.zeros(len(seen), np.int64), np.ones(len(seen), np.int64))
                    continue
                terms, codes, texts = _occurrences(data, offsets)
                if not len(codes):
                    continue
                groups, size = group[i:j], len(terms)
                key, n = np.unique(groups[texts] * size + codes, return_counts=True)
                once = np.unique(texts * size + codes)
                _, held = np.unique(groups[once // size] * size + once % size, return_counts=True)
                yield rows(key // size, terms.take(pa.array(key % size)), n, held)

    chunks = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return chunks.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n, total, terms):
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact at any size; null without terms."""
    above = F.lit(SCALE).cast("decimal(38,0)") * (F.col(n) + PRIOR if isinstance(n, str) else F.lit(n + PRIOR))
    below = (F.col(total) + PRIOR * F.col(terms)).cast("decimal(38,0)")
    return F.when(F.col(terms) > 0, 1 + F.call_function("div", above.cast("decimal(38,0)"), below))


def _matrix(row: dict, size: int) -> np.ndarray:
    """A slice's shares, groups by terms; terms that a group lacks have its zero share."""
    out = np.repeat(np.array(row["zeros"], np.int64)[:, None], size, 1)
    out[row["group"], row["place"]] = row["p"]
    return out


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences of all pairs of a cell's groups over the cell's terms."""
    sides = []
    for k in range(table.num_rows):
        row = {c: table.column(c)[k] for c in ("lang", "lo", "hi", "block", "terms", "names", "zeros", "group", "place", "p")}
        row = {c: v.values.to_numpy(zero_copy_only=False) if c in ("zeros", "group", "place", "p") else v.as_py() for c, v in row.items()}
        sides.append((row["block"], row["names"], _matrix(row, row["terms"])))
    sides.sort(key=lambda s: s[0])
    (_, names, a), (_, others, b) = sides[0], sides[-1]
    same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
    if len(sides) == 1 and not same:                 # no group was dealt to the other block
        names = []
    out = [(names[i], others[j], int(v)) for i in range(len(names)) for j, v in enumerate(np.abs(a[i] - b).sum(1)) if not same or i < j]
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array([x[0] for x in out], pa.string()),
                     "b": pa.array([x[1] for x in out], pa.string()), "value": pa.array([x[2] for x in out], pa.int64())})


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS,
                      group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs (lang, source, text)``.

    A group is a (lang, source) that occurs; null lang, source and text count as '', other
    columns are ignored, repeated rows count each. A language keeps the terms that at least
    ``least_docs`` of its documents hold. Part ``pair``: every other source of the language
    with the summed absolute differences of the two groups' shares (0 where no term is kept).
    Part ``term``: the ``top`` terms whose share in the group most exceeds that in the language.
    Ties rank by item (UTF-8). A language with a single source has no pairs; an empty table
    gives no rows.
    """
    counts = saved(term_counts(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("held"), F.sum("n").alias("n_lang")).where(F.col("held") >= least_docs).drop("held")
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    kept = saved(kept, "kept")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(
        kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n_lang").alias("total_lang")), "lang", "left").fillna(0, ["vocabulary", "total_lang"])
    langs = langs.select("*", F.ceil(F.col("sources") / group_block).alias("group_blocks"),
                         F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / term_block)).alias("term_blocks"))
    langs = saved(langs, "langs")

    # Terms and groups are dealt to blocks by hash and numbered inside their block.
    place = Window.partitionBy("lang", "term_part").orderBy("term")
    terms = kept.join(langs.select("lang", "term_blocks"), "lang").withColumn("term_part", F.pmod(F.xxhash64("term"), "term_blocks")).select(
        "lang", "term", "n_lang", "term_part", (F.row_number().over(place) - 1).alias("place"))
    entries = saved(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "entries")
    block_sizes = entries.groupBy("lang", "term_part").agg((F.max("place") + 1).alias("terms"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    inside = Window.partitionBy("lang", "block").orderBy("source")
    groups = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang").withColumn(
        "block", F.pmod(F.xxhash64("source"), "group_blocks")).withColumn("number", F.row_number().over(inside) - 1)
    groups = saved(groups.withColumn("zero", F.coalesce(_share(0, "total", "vocabulary"), F.lit(0))), "groups")

    shares = entries.join(groups.select("lang", "source", "total", "vocabulary", "total_lang", "block", "number"), ["lang", "source"]).withColumn(
        "p", _share("n", "total", "vocabulary"))

    # Slices of each group block, one a term block; then every slice goes to all cells that need it.
    filled = shares.groupBy("lang", "block", "term_part").agg(F.collect_list(F.struct(
        F.col("number").cast("int").alias("group"), F.col("place").cast("int").alias("place"), F.col("p").cast("int").alias("p"))).alias("x"))
    blocks = groups.groupBy("lang", "block", "group_blocks", "term_blocks").agg(F.sort_array(F.collect_list(F.struct("number", "source", "zero"))).alias("g"))
    slices = blocks.withColumn("term_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("term_blocks") - 1))).join(
        block_sizes, ["lang", "term_part"], "left").join(filled, ["lang", "block", "term_part"], "left")
    none = F.array().cast("array<int>")
    partner = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("group_blocks") - 1))
    cells = slices.select(
        "lang", "block", "term_part", F.coalesce("terms", F.lit(0)).cast("int").alias("terms"), F.col("g.source").alias("names"), F.col("g.zero").alias("zeros"),
        *(F.coalesce(f"x.{c}", none).alias(c) for c in ("group", "place", "p")), partner.alias("partner"))
    cells = cells.select("lang", F.least("block", "partner").alias("lo"), F.greatest("block", "partner").alias("hi"), "term_part", "block", "terms", "names",
                         "zeros", "group", "place", "p")
    partial = cells.groupBy("lang", "lo", "hi", "term_part").applyInArrow(_cell, "lang string, a string, b string, value bigint")
    pairs = saved(partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")

    ranked = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value",
        F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
    pair_part = ranked(pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")), "pair")
    own = shares.withColumn("value", F.col("p") - _share("n_lang", "total_lang", "vocabulary")).where("n > 0 and value > 0")
    term_part = ranked(own.select("lang", "source", F.col("term").alias("item"), "value"), "term").where(F.col("rank") <= top)
    return pair_part.unionAll(term_part)
