"""Token counts by a count-only Viterbi search (operator 3).

The text, with U+2581 for spaces and one put before it, is cut where a run of that mark
begins; no piece spans such a place, so the best segmentation of the whole is that of its
segments. In a segment an Aho-Corasick automaton lists the vocabulary pieces ending at
each place and dynamic programming carries the best score and the number of pieces.
Ties: among equal scores the piece that begins first wins, as in the tokenizers library's
Unigram model; a character that is no piece costs ten less than the lowest score and
counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import text_chunks

CACHE, LONG = 400_000, 64
MARK = "▁"
NORMAL, USER_DEFINED = 1, 4


class Counter(dict):
    """Segment -> its piece count; counted when first met, emptied when full.

    ``pieces``: the vocabulary with scores (log-probabilities or any other).
    """

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            if p:
                self.automaton.add_word(p, (len(p), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - 10.0
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on behind a space: segments cannot be counted alone")
        self.segment = regex.compile(f"{MARK}+[^{MARK}]*")

    def __missing__(self, segment: str) -> int:
        n = self.best(segment)[1]
        if len(segment) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[segment] = n
        return n

    def best(self, segment: str) -> tuple[float, int]:
        """Score and piece count of the best segmentation."""
        score, count = [0.0] + [-float("inf")] * len(segment), [0] * (len(segment) + 1)
        known, done = [False] * (len(segment) + 1), 0       # known[e]: a piece of one character ends at e

        def close(upto: int) -> None:
            for e in range(done + 1, upto + 1):
                if not known[e] and score[e - 1] + self.unknown > score[e]:
                    score[e], count[e] = score[e - 1] + self.unknown, count[e - 1] + len(segment[e - 1].encode())

        for end, (size, value) in self.automaton.iter(segment):   # by end; the longest piece, which begins first, first
            end += 1
            if end > done + 1:
                close(end - 1)
                done = end - 1
            if score[end - size] + value > score[end]:
                score[end], count[end] = score[end - size] + value, count[end - size] + 1
            known[end] = known[end] or size == 1
        close(len(segment))
        return score[-1], count[-1]

    def count(self, text: str) -> int:
        """Pieces of a whole text; an empty one has none."""
        if not text:
            return 0
        return sum(map(self.__getitem__, self.segment.findall(MARK + text.replace(" ", MARK))))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a sentencepiece file's ordinary pieces and their scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    return Counter({p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER_DEFINED)})


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_chars, n_tokens)`` for every row of ``docs (doc_id, text)``.

    A null or empty text has no tokens. Repeated rows and rows without doc_id are counted
    like any other; other columns are ignored. Nothing is shuffled.
    """

    def run(batches):
        pieces = counter(path)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([pieces.count(t) for t in texts], pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars bigint, n_tokens bigint")
