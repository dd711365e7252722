"""Information-theoretic sanitisation of personal data (operator 12), DataFrame expressions only.

Protected entities are the e-mail addresses, IP addresses, payment cards and phone numbers
that patterns find. What the corpus says about them is estimated from co-occurrence: a term
``t`` within ``CONTEXT`` characters of an entity ``e`` in ``n(e, t)`` documents carries the
pointwise mutual information ``log(D n(e, t) / (n(e) n(t)))`` about it, against the entity's
own information content ``log(D / n(e))``. The quotient is the share of the entity that the
term discloses: 1 if the term never occurs without it. Terms above a first threshold are
generalised (to the kind of entity they reveal), above a second one removed, wherever in the
corpus they stand. A term counts only if two documents show it beside the entity in different
contexts, so copies of one passage prove nothing.

All counts cover all documents. Terms are matched back through fixed-size bit tables
(``MARK_BITS``), which only spare work: every term that passes them is joined exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import saved

CONTEXT = 80           # characters on either side of an entity that make its context
GENERALISE = 0.85      # share of an entity's information from which a term is generalised
REMOVE = 0.95          # and from which it is removed
MARK_BITS = 22         # size of a bit table (as a power of two)
BLOCK = 512            # steps of a running sum that are added at a time

_LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The contract's patterns, each begun only where its leftmost match can begin and without
# repeated groups that can be taken back, so that matching is linear and needs no stack:
# a shorter or later start of the same run of characters fails or succeeds with the first.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: What a text must hold for a kind to be looked for.
_NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Whether the digits of a text (at most 20) pass the Luhn test."""
    digits = F.lpad(_digits(text), 20, "0")

    def value(i):
        v = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """Whether a match of the pattern is an entity."""
    if kind == "ip":
        return match.rlike("^" + r"\.".join([_PART] * 4) + "$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _value(kind: str, match: Column) -> Column:
    """The entity a match stands for, written one way."""
    if kind == "email":
        return F.translate(match, UPPER, LOWER)
    return match if kind == "ip" else _digits(match)


def _running(steps: Column) -> Column:
    """Inclusive running sums of an array, block by block (appending to one long array would
    copy it at every step)."""
    def scan(xs, first):
        zero = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(xs, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"] + x)).alias("all")), lambda s: s["all"])

    def summed(xs):
        return F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)

    starts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda k: F.slice(steps, k, F.lit(BLOCK)))
    upto = scan(F.transform(blocks, summed), F.lit(0))
    return F.flatten(F.zip_with(blocks, upto, lambda xs, end: scan(xs, end - summed(xs))))


def _places(found: Column, gaps: Column) -> Column:
    """``(text, from, to, before, after)`` of every match: its code points (end exclusive) and
    the text up to the match before it and after it; ``gaps`` are the pieces between matches."""
    steps = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)).cast("bigint"))
    return F.zip_with(F.transform(found, lambda m, i: F.struct(m.alias("text"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"))),
                      _running(steps), lambda m, at: F.struct(
                          m["text"].alias("text"), at.alias("from"), (at + F.length(m["text"])).alias("to"), m["before"].alias("before"), m["after"].alias("after")))


_MATCH = "array<struct<text:string,from:bigint,to:bigint,before:string,after:string>>"


def _matches(rows: DataFrame, pattern, text: str, out: str, when: Column) -> DataFrame:
    """``rows`` with an array ``out`` of the places of ``pattern`` in ``text`` (empty unless ``when``)."""
    found, gaps = f"{out}_found", f"{out}_gaps"
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    rows = rows.withColumn(found, F.when(when, F.regexp_extract_all(F.col(text), pattern, F.lit(0))))
    rows = rows.withColumn(gaps, F.when(F.size(found) > 0, F.call_function("split", F.col(text), pattern, F.lit(-1))))
    rows = rows.withColumn(out, F.when(F.size(found) > 0, _places(F.col(found), F.col(gaps))).otherwise(F.array().cast(_MATCH)))
    return rows.drop(found, gaps)


def base_matches(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with an array column of matches for every kind."""
    for kind, pattern in PATTERNS.items():
        needed = F.contains(F.col(text), F.lit(_NEEDED[kind])) if _NEEDED[kind] else F.col(text).rlike("[0-9]")
        rows = _matches(rows, pattern, text, kind, needed).withColumn(kind, _entities(kind))
    return rows


def _entities(kind: str) -> Column:
    return F.filter(kind, lambda m: _holds(kind, m["text"]))


def _terms(text: Column) -> Column:
    """Distinct terms of a text: two letters or more, A-Z lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)),
                                                 F.lit(_LETTER + "{2,}"), F.lit(0)))


def _contexts(kind: str) -> Column:
    """``(entity, context)`` of a kind's matches. Words that the context's ends may cut are left out."""
    def cut(side, edge, taken):
        return F.when(F.length(side) > CONTEXT, F.regexp_replace(taken(side, F.lit(CONTEXT + 1)), edge, "")).otherwise(side)

    return F.transform(kind, lambda m: F.struct(
        F.concat(F.lit(kind + ":"), _value(kind, m["text"])).alias("entity"),
        F.concat_ws(" ", cut(m["before"], f"^{_LETTER}+", F.right), m["text"], cut(m["after"], f"{_LETTER}+$", F.left)).alias("context")))


def _marks(keys: DataFrame, column: str) -> Column:
    """A bit table of the 64-bit ``column`` of ``keys`` as a scalar: 2 ** MARK_BITS bits, whatever the rows."""
    words = 1 << (MARK_BITS - 6)
    slot = F.shiftrightunsigned(F.col(column).bitwiseAND(F.lit((1 << MARK_BITS) - 1)), 6)
    bits = keys.groupBy(slot.alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(column).bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    every = keys.sparkSession.range(words).join(bits, F.col("id") == F.col("slot"), "left")
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))), lambda x: x["bits"]).alias("bits"))
    return saved(table, "marks").scalar()


def _marked(marks: Column, key: Column) -> Column:
    slot = F.shiftrightunsigned(key.bitwiseAND(F.lit((1 << MARK_BITS) - 1)), 6).cast("int")
    return F.call_function("getbit", F.element_at(marks, slot + 1), key.bitwiseAND(F.lit(63)).cast("int")) == 1


def disclosing_terms(texts: DataFrame, generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """``(term, share, kind)`` of the terms that disclose an entity, and ``(key, term)`` of the
    texts (by hash) that hold a term seen beside some entity.

    ``texts (key, text)``: one row a document, no nulls. ``share``: the largest share of an
    entity's information that the term carries; ``kind``: that entity's kind.
    """
    found = base_matches(texts).select(F.monotonically_increasing_id().alias("row"), F.concat(*(_contexts(k) for k in KINDS)).alias("found"))
    # Outer, as a plain explode would have the optimiser filter on the array's size, and take the search for it apart.
    found = saved(found.select("row", F.explode_outer("found").alias("x")).where("x is not null").select("row", "x.entity", "x.context"), "entities")
    beside = found.select("row", "entity", F.xxhash64("context").alias("context"), F.explode(_terms(F.col("context"))).alias("term"))
    beside = beside.groupBy("row", "entity", "term").agg(F.min("context").alias("context"))
    pairs = saved(beside.groupBy("entity", "term").agg(F.count("*").alias("both"), F.min("context").alias("lo"), F.max("context").alias("hi")).where(
        "lo <> hi").select("entity", "term", "both"), "beside")
    held = found.select("row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))

    marks = _marks(pairs.select(F.xxhash64("term").alias("h")), "h")
    seen = texts.select("key", F.explode(_terms(F.col("text"))).alias("term")).where(_marked(marks, F.xxhash64("term")))
    seen = saved(seen.join(pairs.select("term").distinct(), "term", "left_semi").select("key", "term"), "seen")
    documents = texts.select(F.count("*").alias("n")).scalar()
    share = F.lit(1.0) + F.log(F.col("both") / F.col("n_term")) / F.log(F.col("documents") / F.col("n_entity"))
    judged = pairs.join(seen.groupBy("term").agg(F.count("*").alias("n_term")), "term").join(held, "entity").withColumn("documents", documents)
    judged = judged.where("n_entity < documents").withColumn("share", share).where(F.col("share") >= generalise)
    best = judged.groupBy("term").agg(F.max(F.struct("share", "entity")).alias("x"))
    return saved(best.select("term", "x.share", F.substring_index("x.entity", ":", 1).alias("kind")), "disclosing"), seen


_SPAN = "array<struct<from:bigint,to:bigint,kind:string,label:string>>"


def sanitised(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``(doc_id, spans, text)`` of every row of ``docs (doc_id, text)``.

    ``spans``: ``(from, to, kind, label)`` in code points, end exclusive: first the entities
    by kind as in :data:`KINDS` and place, then (kind ``term``) the disclosing terms that do
    not begin inside an entity. ``text``: the text with every span replaced by its label
    (``[email]`` and so on; nothing for a removed term; overlapping spans go together under
    the first one's label). A null text is empty and has no spans. Repeated rows are treated
    alike and count as documents, rows without doc_id like any other; other columns are
    ignored; an empty table gives no rows. An entity that every document holds discloses nothing.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    terms, seen = disclosing_terms(texts, generalise=generalise)
    label = F.when(F.col("share") >= remove, "").otherwise(F.concat(F.lit("["), "kind", F.lit("]")))
    held = seen.join(terms.select("term", label.alias("label")), "term").groupBy("key").agg(F.collect_set(F.struct("term", "label")).alias("terms"))
    held = saved(held, "held")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    marks = _marked(_marks(held, "key"), F.col("key"))
    # Only texts that may hold a term go through the join; a key's other texts hold none of its terms.
    rows = rows.where(marks).join(held, "key", "left").select("doc_id", "text", "terms").unionAll(
        rows.where(~marks).select("doc_id", "text", F.lit(None).cast("array<struct<term:string,label:string>>").alias("terms")))
    rows = base_matches(rows)
    pattern = F.concat(F.lit(f"(?i)(?<!{_LETTER})(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(f")(?!{_LETTER})"))
    rows = _matches(rows, F.when(F.size("terms") > 0, pattern).otherwise(F.lit("(?!)")), "text", "term", F.size("terms") > 0)
    labels = F.map_from_entries("terms")

    def spans(kind):
        label = F.lit(f"[{kind}]")
        return F.transform(kind, lambda m: F.struct(m["from"].alias("from"), m["to"].alias("to"), F.lit(kind).alias("kind"),
                                                    (label if kind != "term" else F.element_at(labels, F.translate(m["text"], UPPER, LOWER))).alias("label")))

    rows = rows.select("doc_id", "text", F.concat(*(spans(k) for k in KINDS)).cast(_SPAN).alias("base"), F.when(F.size("term") > 0, spans("term")).cast(_SPAN).alias("terms"))
    # Terms that begin inside an entity go: in order of place, behind the furthest end of an entity so far.
    every = F.array_sort(F.concat("base", "terms"), lambda a, b: F.when(a["from"] != b["from"], F.when(a["from"] < b["from"], -1).otherwise(1)).when(
        (a["kind"] == "term") == (b["kind"] == "term"), 0).when(b["kind"] == "term", -1).otherwise(1))
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast(_SPAN).alias("out"))
    outside = F.aggregate(every, zero, lambda s, x: F.struct(
        F.when(x["kind"] == "term", s["end"]).otherwise(F.greatest(s["end"], x["to"])).alias("end"),
        F.when((x["kind"] == "term") & (x["from"] >= s["end"]), F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out")), lambda s: s["out"])
    rows = rows.select("doc_id", "text", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat("base", outside)).alias("spans"))
    return rows.select("doc_id", "spans", F.when(F.size("spans") > 0, _replaced(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("text"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with its spans (merged where they overlap) replaced by their labels."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["from"] != b["from"], F.when(a["from"] < b["from"], -1).otherwise(1)).when(
        a["to"] != b["to"], F.when(a["to"] > b["to"], -1).otherwise(1)).otherwise(0))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(s, x):
        between = F.substring(text, (s["at"] + 1).cast("int"), (x["from"] - s["at"]).cast("int"))
        return F.when(x["from"] >= s["at"], F.struct(x["to"].alias("at"), F.concat(s["out"], between, x["label"]).alias("out"))).otherwise(
            F.struct(F.greatest(s["at"], x["to"]).alias("at"), s["out"].alias("out")))

    return F.aggregate(ordered, zero, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def sanitised_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the spans of :func:`sanitised`."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"], s["to"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    return sanitised(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *(F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
