"""Benchmark decontamination by a generalised suffix automaton (operator 4).

The benchmark's words are put into suffix automata of bounded size; every document's
words are streamed through them, tracking the longest matching suffix. A position whose
match reaches a window (``window`` item words, or the whole of a shorter item) marks the
window's words as hit. Only runs of words whose neighbouring pairs occur in the benchmark
can hold a match of more than one word, so other words (where the automaton would fall
back to a match of at most one word) are passed over in numpy.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import LOWER, PLAIN_WORD, prefix_hash, quoted, saved, span_hash, text_chunks, word_spans

#: Words of one automaton at most (about 100 bytes of memory a word in each task).
BLOCK_WORDS = 100_000


def words_of(text: str | None) -> list[bytes]:
    """The words of one text (lower-cased A-Z)."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), PLAIN_WORD)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends, strict=True)]


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows of its items."""

    def __init__(self, items: list[tuple[str | None, list[bytes], bool]], window: int):
        """``items``: (id, words, whole); ``whole`` is false for a cut of a longer item."""
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        for _, words, _ in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.length)
        order = sorted(range(n), key=self.length.__getitem__)
        self.at_window = [-1] * n        # the state of a state's suffix of ``window`` words
        self.items: list[set] = [set() for _ in range(n)]
        self.short: list[tuple] = [()] * n   # (words, item) of short items that are suffixes of a state
        for item, words, whole in items:
            v = 0
            for w in words:
                v = self.next[v][w]
            if whole and 0 < len(words) < window:
                self.short[v] += ((len(words), item),)
        for v in order[1:]:
            p = self.link[v]
            self.at_window[v] = -1 if self.length[v] < window else v if self.length[p] < window else self.at_window[p]
            self.short[v] += self.short[p]
        for item, words, _ in items:
            v = 0
            for k, w in enumerate(words, 1):
                v = self.next[v][w]
                if k >= window:
                    self.items[self.at_window[v]].add(item)

    def _new(self, length: int, link: int, edges: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """A state for exactly the strings of ``q`` that end the shorter way through ``p``."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:                # known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def matches(self, words: list[bytes]):
        """``(end, words matched, item ids)`` of every window that occurs in ``words``."""
        v = matched = 0
        for i, w in enumerate(words):
            while v and w not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if w in self.next[v]:
                v, matched = self.next[v][w], matched + 1
            else:
                v = matched = 0
            if matched >= self.window:
                yield i + 1, self.window, self.items[self.at_window[v]]
            if self.short[v]:
                for n, item in self.short[v]:
                    if n <= matched:
                        yield i + 1, n, (item,)


def _hashes(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return span_hash(prefix_hash(raw), ends - np.array([len(w) for w in words], np.int64), ends)


class Matcher:
    """An automaton and the sorted word and word-pair codes that tell where to run it."""

    def __init__(self, items: list[tuple[str | None, list[bytes], bool]], window: int):
        self.automaton, self.window = Automaton(items, window), window
        vocab = sorted({w for _, words, _ in items for w in words})
        h = _hashes(vocab)
        self.words, place = np.unique(h, return_inverse=True)
        code = dict(zip(vocab, place.tolist(), strict=True))
        n = len(self.words)
        self.pairs = np.unique(np.array([code[a] * n + code[b] for _, ws, _ in items for a, b in zip(ws, ws[1:], strict=False)], np.int64))
        short = [ws for _, ws, whole in items if whole and 0 < len(ws) < window]
        self.starts = np.unique(np.array([code[ws[0]] for ws in short], np.int64))  # a short item may begin here

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        """``(text, first word, end word, item ids)`` of the windows in a chunk (``data`` lower-cased)."""
        if not len(starts) or not len(self.words):
            return
        h = span_hash(prefix_hash(data), starts, ends)
        code = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[code] == h
        tied = np.zeros(len(h), bool)    # word i and i + 1 are a pair of the benchmark, in one text
        tied[:-1] = known[:-1] & known[1:]
        tied[first[1:][first[1:] > 0] - 1] = False
        at = np.flatnonzero(tied)
        if len(at):
            pair = code[at] * len(self.words) + code[at + 1]
            tied[at] = _among(self.pairs, pair)
        begin = known.copy()
        begin[1:] &= ~tied[:-1]
        run_start = np.flatnonzero(begin)
        run_end = np.flatnonzero(known & ~tied) + 1
        worth = run_end - run_start >= self.window
        if len(self.starts):
            may = np.concatenate([[0], np.cumsum(known & _among(self.starts, code))])
            worth |= may[run_end] > may[run_start]
        run_start, run_end = run_start[worth], run_end[worth]
        texts = np.searchsorted(first, run_start, "right") - 1
        raw = data.tobytes()
        for t, a, b in zip(texts.tolist(), run_start.tolist(), run_end.tolist(), strict=True):
            words = [raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            for end, n, items in self.automaton.matches(words):
                yield t, a + end - n, a + end, items


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _blocks(benchmark: DataFrame, window: int):
    """Lists of (id, words, whole) of at most :data:`BLOCK_WORDS` words, one list at a time.

    Items are read in blocks by a hash; an item longer than a block is cut into pieces that
    overlap by ``window - 1`` words, which hold all its windows.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-int(size) // (2 * BLOCK_WORDS)) or 1            # a word and its separator are two characters at least
    for k in range(parts):
        block, room = [], BLOCK_WORDS
        for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).toLocalIterator():
            words = words_of(r.text)
            step = BLOCK_WORDS - window
            for s in range(0, max(len(words) - window + 1, 1), step):
                cut = words[s:s + step + window - 1]
                if len(cut) > room:
                    yield block
                    block, room = [], BLOCK_WORDS
                block.append((r.item, cut, len(words) < window))
                room -= len(cut)
        if block:
            yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, text, n_words, n_hit, n_items, items, hits, contaminated)`` for every row of ``docs``.

    ``items`` are the ids of items with a window in the text, sorted as strings; ``hits``
    the hit stretches as flat ``start, end`` byte places of the UTF-8 text;
    ``contaminated``: words are hit, and ``share * n_hit >= n_words``. A null or empty text
    has no words; an item without words has no window; rows of one item_id are one item
    with several texts; an item without id counts as one item with the id "" ; repeated
    documents are judged row by row; ``keep`` columns, whatever their names, are passed on in
    one struct ``kept``, others ignored. Nothing is shuffled.

    The automata are broadcast one after another, each of bounded size; between two of
    them the rows are written to the shared folder.
    """
    spark = docs.sparkSession

    def run(batches, block):
        matcher = Matcher(block.value, window)
        for batch in batches:
            had_items, had_hits, kept = batch.column(2), batch.column(3), batch.column(4)
            for i, j, data, offsets in text_chunks(batch):
                data = LOWER[data]
                starts, ends, first = word_spans(data, offsets, PLAIN_WORD)
                edge = np.zeros(len(starts) + 1, np.int64)
                items: list[set] = [set(x.as_py()) for x in had_items.slice(i, j - i)]
                for t, old in enumerate(had_hits.slice(i, j - i).to_pylist()):
                    if old:
                        a = np.searchsorted(starts, offsets[t] + np.array(old[::2]))
                        b = np.searchsorted(ends, offsets[t] + np.array(old[1::2]), "right")
                        np.add.at(edge, a, 1)
                        np.add.at(edge, b, -1)
                for t, a, b, ids in matcher.hits(data, starts, ends, first):
                    edge[a] += 1
                    edge[b] -= 1
                    items[t].update(x or "" for x in ids)
                hit = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                flat = []
                for t in range(j - i):
                    lo, hi = first[t], first[t + 1]
                    if total[hi] == total[lo]:
                        flat.append([])
                        continue
                    h = np.concatenate([[False], hit[lo:hi], [False]])
                    a, b = np.flatnonzero(h[1:] & ~h[:-1]), np.flatnonzero(~h[1:] & h[:-1]) - 1
                    flat.append(np.stack([starts[lo + a], ends[lo + b]], 1).ravel() - offsets[t])
                n_words = np.diff(first)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(flat, pa.list_(pa.int64())),
                    pa.array(n_words.astype(np.int64)), pa.array((total[first[1:]] - total[first[:-1]]).astype(np.int64)),
                    kept.slice(i, j - i)], ["doc_id", "text", "items", "hits", "n_words", "n_hit", "kept"])

    # ``keep`` travels as one struct, so its names cannot clash with the operator's.
    rows = docs.select("doc_id", "text", F.array().cast("array<string>").alias("items"), F.array().cast("array<bigint>").alias("hits"),
                       (F.struct(*quoted(keep)) if keep else F.lit(None).cast("int")).alias("kept"))
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("text string, items array<string>, hits array<bigint>, n_words bigint, n_hit bigint"), rows.schema["kept"]])
    out, passes = rows, 0
    for block in _blocks(benchmark, window):
        if passes:
            out = saved(out, "hits").select("doc_id", "text", "items", "hits", "kept")
        out = out.mapInArrow(functools.partial(run, block=spark.sparkContext.broadcast(block)), schema)
        passes += 1
    if not passes:                       # a benchmark without words: only the words are counted
        out = out.mapInArrow(functools.partial(run, block=spark.sparkContext.broadcast([])), schema)
    return out.select("doc_id", "text", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "hits",
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), *(["kept"] if keep else []))


def without_hits(judged: DataFrame, whole_text: bool = True) -> DataFrame:
    """``(doc_id, text)`` of :func:`contamination` rows with their excess removed: the hit
    stretches of contaminated texts are cut out (``whole_text``: the whole text goes)."""

    def run(batches):
        for batch in batches:
            texts = []
            for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at, parts = (text or "").encode(), 0, []
                for a, b in zip(hits[::2], hits[1::2], strict=True):
                    parts.append(raw[at:a])
                    at = b
                texts.append(b"".join([*parts, raw[at:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    clean = judged.where(~F.col("contaminated")).select("doc_id", "text")
    if whole_text:
        return clean
    cut = judged.where("contaminated").select("doc_id", "text", "hits")
    return clean.unionAll(cut.mapInArrow(run, f"doc_id {dict(judged.dtypes)['doc_id']}, text string"))


def digest(items: list[str]) -> str:
    """What :func:`contamination_digest` computes for one document (for tests)."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, from the rows of :func:`contamination`."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
