"""Alignment of two tokenizers over the same texts (operator 11).

Both tokenizers cut a text's bytes into intervals. All intervals of A and B are lexsorted by
their start, the running maximum of their ends is accumulated, and a group breaks where a
start reaches that maximum: there both tokenizers end a token. Inside the groups the
overlapping A-B occurrences are expanded by binary search. Whole chunks of texts are aligned
at once, as each text covers the same bytes in both sequences.

How often an id pair is linked is counted over the corpus. Tokens that end together end
alike, so one token's bytes are a suffix of the other's: the pairs that can occur at all
are known from the two vocabularies (``Pairing.keys``, 324,297 for the two public files).
The counts are an array over that fixed list; it alone goes to the driver and back.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer
from .ordinary import ordinary_encoder
from .text import saved, text_chunks

CHUNK = 1 << 18          # bytes of text that are aligned at a time (or one longer text)
LINKS = 500_000          # links that are looked up at a time (or one longer text's)


class Pairing:
    """The encoders, token sizes and possible end-together pairs of two tokenizer files."""

    def __init__(self, path_a: str, path_b: str):
        bpe = tokenizer(path_a)
        ranks = dict(zip(bpe.bytes_of, bpe.ids, strict=True))
        if any(x >= y for x, y in zip(bpe.ids[256:], bpe.ids[257:], strict=False)):
            raise ValueError(f"{path_a}: ids do not follow the merges")
        self.encode_a = ordinary_encoder(ranks)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._bytes(i) for i in range(self.pieces.get_piece_size())]
        bytes_a = [b""] * (max(bpe.ids) + 1)
        for b, i in ranks.items():
            bytes_a[i] = b
        self.width = len(self.bytes_b)
        self.size_a, self.size_b = (np.array([len(b) for b in t], np.int64) for t in (bytes_a, self.bytes_b))
        self.keys = self._possible(ranks)
        # Texts of an id, once for every sign that can follow it.
        ids = range(max(len(bytes_a), self.width))
        self.signed = [f"{i}{sign}" for sign in ",|;" for i in ids]
        self.of_sign = {sign: k * len(ids) for k, sign in enumerate(",|;")}

    def _bytes(self, i: int) -> bytes:
        if self.pieces.is_control(i) or self.pieces.is_unknown(i):
            return b""
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def _possible(self, ranks: dict[bytes, int]) -> np.ndarray:
        """Sorted ``a * width + b`` of all id pairs of which one's bytes are a suffix of the other's."""
        same = defaultdict(list)
        for i, b in enumerate(self.bytes_b):
            if b:
                same[b].append(i)
        found = {a * self.width + b for t, a in ranks.items() for k in range(len(t)) for b in same.get(t[k:], ())}
        found |= {ranks[t[k:]] * self.width + b for b, t in enumerate(self.bytes_b) for k in range(len(t)) if t[k:] in ranks}
        return np.array(sorted(found), np.int64)

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A's and B's ids of every text; none where a tokenizer's bytes are not the text's."""
        none, ids_a, ids_b = np.zeros(0, np.int64), [], []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            whole = b" " + text.encode()
            a = self.encode_a(" " + text) if text and b"".join(map(self.bytes_b.__getitem__, b)) == whole else none
            if self.size_a[a].sum() != len(whole):
                a = none
            ids_a.append(a.astype(np.int64))
            ids_b.append(np.array(b, np.int64) if len(a) else none)
        return ids_a, ids_b


@functools.lru_cache(maxsize=1)
def pairing(path_a: str, path_b: str) -> Pairing:
    return Pairing(path_a, path_b)


def coalesced(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(group of each A token, of each B token, A and B of each overlapping pair)`` of two
    sequences of adjoining intervals that cover the same bytes, given by their ends."""
    start_a, start_b = (np.concatenate([[0], e[:-1]]) if len(e) else e for e in (end_a, end_b))
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    side = np.repeat([0, 1], [len(end_a), len(end_b)])
    order = np.lexsort((side, start))
    furthest = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order[1:]] >= furthest[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = last - first
    a = np.repeat(np.arange(len(end_a)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return group[:len(end_a)], group[len(end_a):], a, b


def _written(ids_a, ids_b, group_a, group_b, p: Pairing) -> np.ndarray:
    """Numbers of the signed texts of a chunk's groups, ``a,a|b,b;`` each, in order."""
    last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
    code = np.concatenate([ids_a + np.where(last_a, p.of_sign["|"], p.of_sign[","]), ids_b + np.where(last_b, p.of_sign[";"], p.of_sign[","])])
    return code[np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")]


def _chunks(batches, path_a: str, path_b: str) -> Iterator[tuple]:
    """Per chunk: doc_ids, tokens of each text, the chunk's ids, groups and overlapping pairs."""
    p = pairing(path_a, path_b)
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch, max_bytes=CHUNK):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            of_a, of_b = p.tokens(texts)
            ids_a, ids_b = np.concatenate(of_a), np.concatenate(of_b)
            end_a, end_b = np.cumsum(p.size_a[ids_a]), np.cumsum(p.size_b[ids_b])
            yield p, batch.column(0).slice(i, j - i), of_a, of_b, ids_a, ids_b, end_a, end_b, *coalesced(end_a, end_b)


def _by_text(of: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int64)


def _lists(places: np.ndarray, values: np.ndarray, kind=np.int32) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(values.astype(kind)))


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(doc_id, ids_a, ids_b, group_a, group_b, overlap_a, overlap_b)`` of every row of ``docs (doc_id, text)``.

    ``path_a``: a byte-level BPE file, which encodes a space and the text; ``path_b``: a
    sentencepiece model, which adds the space itself. ``group_*``: each token's group (from 0
    within the text); ``overlap_*``: places of the A and the B token of every overlapping
    pair. Special tokens' strings are ordinary text. A text that is null, empty, or not the
    bytes of its tokens (B normalises, or knows no U+2581 but the space) has no tokens.
    Repeated rows and rows without doc_id are aligned like any other; other columns are
    ignored; an empty table gives no rows. Nothing is shuffled.
    """

    def run(batches):
        for _, doc_ids, of_a, of_b, ids_a, ids_b, _, _, group_a, group_b, a, b in _chunks(batches, path_a, path_b):
            at_a, at_b = _by_text(of_a), _by_text(of_b)
            pairs = np.searchsorted(a, at_a)
            first_group = np.append(group_a, 0)[at_a[:-1]] if len(group_a) else np.zeros(len(of_a), np.int64)
            first_group = np.where(np.diff(at_a) > 0, first_group, 0)
            yield pa.RecordBatch.from_arrays(
                [doc_ids, _lists(at_a, ids_a), _lists(at_b, ids_b), _lists(at_a, group_a - np.repeat(first_group, np.diff(at_a))),
                 _lists(at_b, group_b - np.repeat(first_group, np.diff(at_b))), _lists(pairs, a - np.repeat(at_a[:-1], np.diff(pairs))),
                 _lists(pairs, b - np.repeat(at_b[:-1], np.diff(pairs)))],
                ["doc_id", "ids_a", "ids_b", "group_a", "group_b", "overlap_a", "overlap_b"])

    lists = ", ".join(f"{c} array<int>" for c in ("ids_a", "ids_b", "group_a", "group_b", "overlap_a", "overlap_b"))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {lists}")


def _linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups_sha256, links)``; ``links``: the place in
    ``Pairing.keys`` of every A-B pair of the text whose byte ranges end together."""

    def run(batches):
        for p, doc_ids, of_a, of_b, ids_a, ids_b, end_a, end_b, group_a, group_b, a, b in _chunks(batches, path_a, path_b):
            at_a, at_b = _by_text(of_a), _by_text(of_b)
            together = end_a[a] == end_b[b]
            a, b = a[together], b[together]
            links = np.searchsorted(p.keys, ids_a[a] * p.width + ids_b[b])
            at_links = np.searchsorted(a, at_a)
            code, at = _written(ids_a, ids_b, group_a, group_b, p), (at_a + at_b).tolist()
            hashes = [hashlib.sha256("".join(map(p.signed.__getitem__, code[x:y].tolist()))[:-1].encode()).hexdigest() if x < y else "" for x, y in zip(at, at[1:], strict=False)]
            groups = np.zeros(len(of_a), np.int64)
            some = np.flatnonzero(np.diff(at_a) > 0)
            groups[some] = group_a[at_a[some + 1] - 1] - group_a[at_a[some]] + 1
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(np.diff(at_a)), pa.array(np.diff(at_b)), pa.array(groups), pa.array(hashes, pa.string()), _lists(at_links, links)],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<int>")


def link_counts(linked: DataFrame, possible: int) -> DataFrame:
    """``(pair, n)``: how many links hold each pair; a task sends one row a pair at most."""

    def run(batches):
        n = np.zeros(possible, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=possible)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["pair", "n"])

    return linked.select("links").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_digest(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The contract's columns: counts of tokens, groups and links, and how common the links are.

    ``n_best`` counts the links whose count is the highest of their B id (ties included),
    ``count_sum`` adds the links' counts. Edge rows as in :func:`alignments`; a text without
    tokens has zeros and an empty ``groups_sha256``.
    """
    linked = saved(_linked(docs, path_a, path_b), "linked")
    p = pairing(path_a, path_b)
    table = link_counts(linked, len(p.keys)).toArrow()                # one row a possible pair at most
    count = np.zeros(len(p.keys), np.int64)
    count[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    highest = np.zeros(p.width, np.int64)
    np.maximum.at(highest, p.keys % p.width, count)
    shared = docs.sparkSession.sparkContext.broadcast((count, count == highest[p.keys % p.width]))   # 9 bytes a possible pair

    def run(batches):
        n, best = shared.value
        for batch in batches:
            links = batch.column(5)
            values, at = links.flatten().to_numpy(), np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())]).astype(np.int64)
            n_best, count_sum = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
            i = 0
            while i < len(at) - 1:
                j = max(i + 1, int(np.searchsorted(at, at[i] + LINKS, "right")) - 1)
                some, places = values[at[i]:at[j]], at[i:j + 1] - at[i]
                n_best[i:j] = np.diff(np.concatenate([[0], np.cumsum(best[some])])[places])
                count_sum[i:j] = np.diff(np.concatenate([[0], np.cumsum(n[some])])[places])
                i = j
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4)), pa.array(np.diff(at)), pa.array(n_best), pa.array(count_sum), batch.column(4)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return linked.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
