"""Removal of repeated 100-byte strings by prefix-free parsing (operator 7).

A string of ``length`` bytes is *repeated* if it also starts earlier: in a document before
(smaller doc_id) or earlier in the same one. Every byte inside a repeated string goes.

Parsing: a rolling hash over ``GRAM`` bytes puts a trigger into every string of ``length``
bytes - the place of its smallest hash - so equal strings have the trigger at the same
place. Consecutive strings with one trigger make a phrase, which is all the text they
cover; phrases overlap, and every string lies in exactly one.

* Dictionary (first round): phrases meet by trigger and content. A phrase that occurred
  before is repeated as a whole. Only a trigger with several different phrases leaves
  something open: their strings may be equal in part.
* Parse order (second round): the open phrases' strings are sorted by the hashes of
  trigger and string, then document and place, and all but the first of equal strings are
  repeated.
* Last round: each document's repeated stretches are cut out.

No suffix array of dictionary or parse is built: hash grouping replaces both. Only equality
of strings and the first place of each are asked for, so no lexicographic order is needed,
and groups by hash can be dealt to parts without a global order. Results are exact up to
64-bit hashes.

Rows travel packed: one compressed row holds what a chunk of text sends to one part, and a
part is worked off alone, in bounded memory: the number of parts follows the bytes of text. A phrase met many times in a chunk is sent
once, and a trigger with many phrases in one chunk is dealt out string by string, so no
frequent copy, line or passage gathers in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _U, mixed, prefix_hash, quoted, saved, span_hash, text_chunks

GRAM = 32
CHUNK = 2 << 20          # bytes of text that are parsed at a time (or one longer text)
SEGMENT = 1 << 19        # places whose triggers are found at a time (below 2**23)
PART_BYTES = 16 << 20    # bytes of text for each part: a part's work does not grow with the corpus
CROWD = 16               # phrases of one trigger in one chunk from which on it is dealt string by string
FLUSH = 4 << 20          # bytes that a task gathers before it sends them
_PLACE = _U((1 << 23) - 1)
RUNS, MARKS, ASKS, STRINGS, TEXT = range(5)
#: Columns of the packed rows: a document is told by its doc_id and a hash of its text.
_KINDS = {
    RUNS: {"g": "u8", "c": "u8", "d": "i8", "h": "i4", "lo": "i8", "more": "u4", "at": "u4", "crowd": "u1"},
    MARKS: {"d": "i8", "h": "i4", "lo": "i8", "more": "i4"},
    ASKS: {"g": "u8", "d": "i8", "h": "i4", "lo": "i8", "more": "u4", "crowd": "u1"},
    STRINGS: {"g": "u8", "s": "u8", "d": "i8", "h": "i4", "lo": "i8"},
}
_ROW = "part int, kind int, data binary"


def _pack(kind: int, cols: dict[str, np.ndarray], tail: bytes = b"") -> bytes:
    n = len(cols["d"])
    raw = b"".join([np.int64(n).tobytes(), *(np.ascontiguousarray(cols[k], t).tobytes() for k, t in _KINDS[kind].items()), tail])
    return zstandard.compress(raw, 1)


def _unpack(kind: int, blob: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    raw = zstandard.decompress(blob)
    n, at, cols = int(np.frombuffer(raw, np.int64, 1)[0]), 8, {}
    for k, t in _KINDS[kind].items():
        cols[k] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    return cols, raw[at:]


def _joined(kind: int, many: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([m[k] for m in many]) if many else np.zeros(0, t) for k, t in _KINDS[kind].items()}


def _picked(cols: dict[str, np.ndarray], kind: int, rows) -> dict[str, np.ndarray]:
    return {k: cols[k][rows] for k in _KINDS[kind]}


def _by_part(part: np.ndarray):
    """``(part, its rows)`` for every part that has rows."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cut) if len(order) else ():
        yield int(part[rows[0]]), rows


def _document_part(cols: dict[str, np.ndarray], parts: int) -> np.ndarray:
    return (mixed(cols["d"].astype(np.uint64) ^ cols["h"].astype(np.uint64), 5) % _U(parts)).astype(np.int64)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                       pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "data"])


def phrases(data: np.ndarray, offsets: np.ndarray, length: int):
    """``(g, c, text, lo, more, at)`` of a chunk's phrases: trigger hash, content hash, text
    number, first string's place in the chunk, further strings, the trigger's distance."""
    whole = np.diff(offsets) >= length
    edge = np.zeros(len(data) + 1, np.int8)
    edge[offsets[:-1][whole]] += 1
    edge[offsets[1:][whole] - length + 1] -= 1
    starts_string = np.cumsum(edge[:-1], dtype=np.int8) > 0
    h = prefix_hash(data)
    found = []
    for base in range(0, max(len(data) - length + 1, 0), SEGMENT):
        end = min(base + SEGMENT + length - 1, len(data))
        place = np.arange(base, end - GRAM + 1)
        gram = span_hash(h, place, place + GRAM)
        least = (gram & ~_PLACE) | (place - base).astype(np.uint64)
        reach, want = 1, length - GRAM + 1
        while 2 * reach <= want:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < want:
            least = np.minimum(least[:reach - want], least[want - reach:])
        p = np.flatnonzero(starts_string[base:base + len(least)])
        at = (least[p] & _PLACE).astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        lo, hi, at = p[first] + base, p[np.append(first[1:], len(p)) - 1] + base if len(first) else p[:0], at[first]
        found.append((gram[at], span_hash(h, lo, hi + length), lo, hi - lo, at + base - lo))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    g, c, lo, more, at = (np.concatenate(x) for x in zip(*found, strict=True))
    return g, c, np.searchsorted(offsets, lo, "right") - 1, lo, more, at


def _new(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether each row of an order differs from the row before in any of the keys."""
    out = np.zeros(len(order), bool)
    out[:1] = True
    for k in keys:
        k = k[order]
        out[1:] |= k[1:] != k[:-1]
    return out


def _parse(docs: DataFrame, parts: int, length: int) -> DataFrame:
    """Packed phrases of all documents, by trigger; copies within a chunk go straight to their documents."""

    def run(batches):
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j, data, offsets in text_chunks(batch, max_bytes=CHUNK):
                g, c, text, lo, more, at = phrases(data, offsets, length)
                cols = {"g": g, "c": c, "d": ids[i:j][text], "h": tags[i:j][text], "lo": lo - offsets[text], "more": more, "at": at,
                        "crowd": np.zeros(len(g), np.uint8)}
                out = []
                copy, order, trigger = _copies(cols)
                out += _marked(cols, copy, parts)
                alone = order[~copy[order]]                       # one row a phrase, by trigger
                size = np.bincount(trigger[~copy[order]]) if len(alone) else np.zeros(0, int)
                crowded = size[trigger[~copy[order]]] > CROWD
                cols["crowd"][alone[crowded]] = 1
                asked = alone[crowded]
                out += [(p, ASKS, _pack(ASKS, _picked(cols, ASKS, asked[r]))) for p, r in _by_part(_document_part(_picked(cols, ASKS, asked), parts))]
                first = _new(alone, cols["g"])
                sent = alone[~crowded | first]                    # of a crowd one phrase goes on, as a sign
                out += [(p, RUNS, _pack(RUNS, _picked(cols, RUNS, sent[r]))) for p, r in _by_part((mixed(g[sent], 3) % _U(parts)).astype(np.int64))]
                yield _batch(out)

    return docs.select("d", "h", "text").mapInArrow(run, _ROW)


def _copies(cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(copy, order, trigger)``: which phrases occurred before (rows of one place are one
    occurrence), the rows by trigger, content and place, and the triggers' numbers along it."""
    order = np.lexsort((cols["lo"], cols["h"], cols["d"], cols["c"], cols["g"]))
    new = _new(order, cols["g"], cols["c"])
    owner = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    copy = np.zeros(len(order), bool)
    copy[order] = (cols["d"][order] != cols["d"][owner]) | (cols["h"][order] != cols["h"][owner]) | (cols["lo"][order] != cols["lo"][owner])
    return copy, order, np.cumsum(_new(order, cols["g"])) - 1


def _marked(cols: dict[str, np.ndarray], rows: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    mine = _picked(cols, MARKS, np.flatnonzero(rows))
    return [(p, MARKS, _pack(MARKS, _picked(mine, MARKS, r))) for p, r in _by_part(_document_part(mine, parts))]


def _dealt(rows: DataFrame, spread: int) -> DataFrame:
    """Rows of one part together, kinds in order."""
    return rows.repartition(spread, "part").sortWithinPartitions("part", "kind")


def _parts_of(batches):
    """``(part, {kind: blobs})`` of successive parts."""
    part, have = None, {}
    for batch in batches:
        for p, kind, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if p != part and have:
                yield part, have
                have = {}
            part = p
            have.setdefault(kind, []).append(blob)
    if have:
        yield part, have


def _dictionary(rows: DataFrame, parts: int) -> DataFrame:
    """First round: marks of repeated phrases, and questions about triggers with several phrases."""

    def run(batches):
        for part, have in _parts_of(batches):
            out = [(part, kind, blob) for kind in (MARKS, ASKS) for blob in have.get(kind, ())]
            cols = _joined(RUNS, [_unpack(RUNS, b)[0] for b in have.get(RUNS, ())])
            copy, order, trigger = _copies(cols)
            out += _marked(cols, copy, parts)
            alone, number = order[~copy[order]], trigger[~copy[order]]
            if len(alone):
                crowd = np.zeros(number[-1] + 1, bool)
                np.logical_or.at(crowd, trigger, cols["crowd"][order] > 0)
                several = np.bincount(number[_new(alone, cols["g"], cols["c"])], minlength=len(crowd)) > 1
                asked = alone[(several | crowd)[number]]
                ask = _picked(cols | {"crowd": crowd[trigger[np.argsort(order, kind="stable")]].astype(np.uint8)}, ASKS, asked)
                out += [(p, ASKS, _pack(ASKS, _picked(ask, ASKS, r))) for p, r in _by_part(_document_part(ask, parts))]
            yield _batch(out)

    return rows.mapInArrow(run, _ROW)


def _open_strings(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """The open phrases' texts, by trigger; of crowded triggers each string's hash, by string."""

    def send(asks, texts):
        """``asks``: picked columns of phrases, ``texts`` their bytes, one array."""
        size = asks["more"].astype(np.int64) + length
        begin = np.cumsum(size) - size
        crowded = asks["crowd"] > 0
        out = []
        for p, r in _by_part(np.where(crowded, -1, (mixed(asks["g"], 3) % _U(parts)).astype(np.int64))):
            if p >= 0:
                tail = b"".join(texts[begin[k]:begin[k] + size[k]].tobytes() for k in r)
                out.append((p, TEXT, _pack(ASKS, _picked(asks, ASKS, r), tail)))
        many = np.flatnonzero(crowded)
        if len(many):
            s = _strings(_picked(asks, ASKS, many), np.concatenate([texts[begin[k]:begin[k] + size[k]] for k in many]), length)
            out += [(p, STRINGS, _pack(STRINGS, _picked(s, STRINGS, r))) for p, r in _by_part((mixed(s["s"], 4) % _U(parts)).astype(np.int64))]
        return out

    def run(batches):
        part, asks, held, texts, size = None, None, [], [], 0
        for p, kind, blob, d, h, text in _walk(batches):
            if p != part:
                part, asks = p, []
            if kind == ASKS:
                asks.append(_unpack(ASKS, blob)[0])
            elif kind == TEXT and asks:
                if isinstance(asks, list):
                    asks = _sorted_by_document(ASKS, asks)
                mine = _of_document(asks, ASKS, d, h)
                if len(mine["d"]):
                    raw = np.frombuffer(zstandard.decompress(text), np.uint8)
                    held.append(mine)
                    texts.append(np.concatenate([raw[a:a + n + length] for a, n in zip(mine["lo"].tolist(), mine["more"].tolist(), strict=True)]))
                    size += len(texts[-1])
                    if size > FLUSH:
                        yield _batch(send(_joined(ASKS, held), np.concatenate(texts)))
                        held, texts, size = [], [], 0
        if held:
            yield _batch(send(_joined(ASKS, held), np.concatenate(texts)))

    return rows.mapInArrow(run, _ROW)


def _strings(asks: dict[str, np.ndarray], texts: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """All strings of phrases with their bytes ``texts``: one row a string."""
    more = asks["more"].astype(np.int64)
    size = more + length
    of = np.repeat(np.arange(len(more)), more + 1)
    step = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    begin = (np.cumsum(size) - size)[of] + step
    return {"g": asks["g"][of], "s": span_hash(prefix_hash(texts), begin, begin + length), "d": asks["d"][of], "h": asks["h"][of], "lo": asks["lo"][of] + step}


def _parse_order(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """Second round: equal strings of the open phrases in corpus order; all but the first are marked."""

    def run(batches):
        for _, have in _parts_of(batches):
            many = [_unpack(STRINGS, b)[0] for b in have.get(STRINGS, ())]
            for blob in have.get(TEXT, ()):
                asks, tail = _unpack(ASKS, blob)
                many.append(_strings(asks, np.frombuffer(tail, np.uint8), length))
            s = _joined(STRINGS, many)
            copy, _, _ = _copies(s | {"c": s["s"]})
            s = _picked(s, STRINGS, np.flatnonzero(copy))
            order = np.lexsort((s["lo"], s["h"], s["d"]))
            s = _picked(s, STRINGS, order)
            new = np.ones(len(order), bool)                       # strings one after another are one stretch
            new[1:] = (s["d"][1:] != s["d"][:-1]) | (s["h"][1:] != s["h"][:-1]) | (s["lo"][1:] > s["lo"][:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(order)) - 1 if len(first) else first
            stretch = {"d": s["d"][first], "h": s["h"][first], "lo": s["lo"][first], "more": s["lo"][last] - s["lo"][first]}
            yield _batch(_marked(stretch, np.ones(len(first), bool), parts))

    return rows.mapInArrow(run, _ROW)


def _walk(batches):
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)


def _sorted_by_document(kind: int, many: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    cols = _joined(kind, many)
    return _picked(cols, kind, np.lexsort((cols["lo"], cols["h"], cols["d"])))


def _of_document(cols: dict[str, np.ndarray], kind: int, d: int, h: int) -> dict[str, np.ndarray]:
    a, b = np.searchsorted(cols["d"], d), np.searchsorted(cols["d"], d, "right")
    a, b = a + np.searchsorted(cols["h"][a:b], h), a + np.searchsorted(cols["h"][a:b], h, "right")
    return _picked(cols, kind, slice(a, b))


def _spans(marks: dict[str, np.ndarray], length: int) -> np.ndarray:
    """Maximal stretches ``[start, end)`` covered by a document's marks (ascending), as rows."""
    a, b = marks["lo"], np.maximum.accumulate(marks["lo"] + marks["more"] + length) if len(marks["lo"]) else marks["lo"]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return np.stack([a[first], b[np.append(first[1:], len(a)) - 1]], 1) if len(a) else np.zeros((0, 2), np.int64)


def _on_characters(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """Stretches shrunk to the whole UTF-8 characters in them."""
    out = []
    for a, b in spans.tolist():
        while a < b and raw[a] & 0xC0 == 0x80:                         # begins inside a character
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:        # ends inside one
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def repeated_substrings(docs: DataFrame, length: int = 100, carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept, *carry)`` for every row of ``docs (doc_id, text)``.

    ``spans``: the removed stretches as flat ``start, end`` byte places; ``kept``: the bytes
    left. With ``whole_characters`` a stretch leaves out characters that it covers only in
    part, so what is kept is text. Null counts as an empty text; a text shorter than ``length`` (at least ``GRAM``) keeps all. Rows
    without doc_id come before all others. Rows with one doc_id and one text are one
    document (each gets the result); different texts under one doc_id are documents in the
    order of a hash of their texts. ``carry`` columns are passed on; other columns are ignored.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spark = docs.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(spread, -(-n_bytes // PART_BYTES))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("d"), F.hash(text).alias("h"), text.alias("text"),
                        F.struct(F.col("doc_id"), *quoted(carry)).alias("row"))
    row_type = keyed.schema["row"].dataType

    def pack_texts(batches):
        for batch in batches:
            d, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            part = _document_part({"d": d, "h": h}, parts)
            for i, j, data, offsets in text_chunks(batch):
                raw, c = data.tobytes(), zstandard.ZstdCompressor(level=1)
                blobs = [c.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[i:j].astype(np.int32)), pa.array(np.full(n, TEXT, np.int32)), pa.nulls(n, pa.binary()), batch.column(0).slice(i, n),
                     batch.column(1).slice(i, n), pa.array(blobs, pa.binary()), batch.column(3).slice(i, n)], ["part", "kind", "data", "d", "h", "text", "row"])

    full = T.StructType.fromDDL(f"{_ROW}, d bigint, h int, text binary").add("row", row_type)
    texts = keyed.mapInArrow(pack_texts, full)

    def with_texts(rows: DataFrame, kind: int) -> DataFrame:
        rows = rows.where(F.col("kind") == kind)
        return _dealt(rows.unionByName(texts, allowMissingColumns=True), spread)

    first = saved(_dictionary(_dealt(_parse(keyed, parts, length), spread), parts), "repeats")
    open_rows = _open_strings(with_texts(first, ASKS), parts, length)
    second = _parse_order(_dealt(open_rows, spread), parts, length)

    def cut(batches):
        part, marks, out, size = None, [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa_row), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.binary())], ["row", "n_bytes", "spans", "kept"])

        for batch in batches:
            pa_row = batch.schema.field("row").type
            rows = batch.column(batch.schema.get_field_index("row"))
            for k, (p, kind, blob, d, h, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)):
                if p != part:
                    part, marks = p, []
                if kind == MARKS:
                    marks.append(_unpack(MARKS, blob)[0])
                    continue
                if isinstance(marks, list):
                    marks = _sorted_by_document(MARKS, marks)
                spans = _spans(_of_document(marks, MARKS, d, h), length)
                raw, at, kept = zstandard.decompress(text), 0, []
                if whole_characters:
                    spans = _on_characters(raw, spans)
                for a, b in spans.tolist():
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((rows[k].as_py(), len(raw), spans.ravel(), b"".join(kept)))
                size += len(raw)
                if size > FLUSH:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    done = with_texts(first.unionByName(second), MARKS).mapInArrow(
        cut, T.StructType([T.StructField("row", row_type), *T.StructType.fromDDL("n_bytes bigint, spans array<bigint>, kept binary")]))
    return done.select("row.doc_id", "n_bytes", "spans", "kept", *(F.col(f"row.{q}").alias(c) for c, q in zip(carry, quoted(carry), strict=True)))


def repeated_substrings_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the rows of :func:`repeated_substrings`."""
    return repeated_substrings(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.floor(F.size("spans") / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
