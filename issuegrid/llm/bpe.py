"""Byte-level BPE encoding and decoding (operator 9).

A pre-token is encoded by longest token matches (one Aho-Corasick pass gives the longest
token at every place) and backtracking: a token is taken only if its pair with the token
before it is compatible, that is if the merges of the two alone would leave them as they
are. A sequence of pairwise compatible tokens is the merges' result, so the output is
exact and the work linear in the pre-token. Decoding gathers bytes by an offset table.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .text import text_chunks

#: The pre-tokenizer's pattern (fixed by the tokenizer files).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000          # pre-tokens a task remembers at most
PAIRS = 1_000_000        # token pairs likewise
LONG = 64                # longer pre-tokens are not remembered
SLICE = 1 << 20          # characters that are cut into pre-tokens at a time


#: Stands for a character that is neither letter, number nor white space (never assigned).
OTHER = "\uffff"


@functools.cache
def _unknown_letters() -> re.Pattern:
    """Characters that the regex library calls letters or numbers but the tokenizers library,
    whose Unicode tables are older, does not: it leaves them with the sign before them. Only
    characters that Python's own, still older tables do not know can differ."""
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    recent = "".join(chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn")
    points = np.array([ord(c) for c in regex.findall(r"[\p{L}\p{N}]", recent) if len(split("!" + c)) == 1] or [ord(OTHER)])
    ranges = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return re.compile("[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in ranges) + "]")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in plain]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class _Remembered(dict):
    """Pre-token -> its ids as int32 bytes; encoded when first met, emptied when full."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.encode = tokenizer.encode_piece

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class _Pairs(dict):
    """(token, next token) -> whether the merges of the two together end as these two tokens.

    Undoes the later of the two tokens' merges step by step: at each border between what
    is left of them, a merge made earlier than the undone one would have joined them.
    """

    def __init__(self, halves: list[tuple[int, int]]):
        super().__init__()
        self.halves = halves
        self.merge = {h: k for k, h in enumerate(halves) if k >= 256}

    def __missing__(self, pair: tuple[int, int]) -> bool:
        (left, right), before, good = pair, len(self.halves), True
        while True:
            joined = self.merge.get((left, right))
            if joined is not None and joined < before:
                good = False
                break
            if left < 256 and right < 256:
                break
            if left > right:
                before, left = left, self.halves[left][1]
            else:
                before, right = right + 1, self.halves[right][0]
        if len(self) >= PAIRS:
            self.clear()
        self[pair] = good
        return good


class Tokenizer:
    """Encoder and decoder of one byte-level BPE file of the tokenizers library.

    Inner token numbers are the 256 bytes, then the merges by rank; ``ids`` maps them to
    the file's ids. A file with other settings than plain byte-level BPE is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, letters = file["model"], _byte_letters()
        if (file.get("normalizer") or model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges")
                or file["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        vocab = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        parts = [tuple(bytes(letters[c] for c in x) for x in m) for m in merges]
        self.bytes_of = [bytes([b]) for b in range(256)] + [a + b for a, b in parts]
        number = {b: k for k, b in enumerate(self.bytes_of)}
        if len(number) != len(self.bytes_of):
            raise ValueError(f"{path}: two merges make one token")
        self.ids = [vocab[b] for b in self.bytes_of]
        self.halves = [(k, k) for k in range(256)] + [(number[a], number[b]) for a, b in parts]
        self.pairs = _Pairs(self.halves)
        self.packed = [np.int32(i).tobytes() for i in self.ids]
        self.number = {b.decode("latin-1"): k for b, k in number.items()}
        self.size = [len(b) for b in self.bytes_of]
        self.most = max(self.size)
        self.shorter = [next((number[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in number), -1) for b in self.bytes_of]
        table = {i: b for b, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.blob = np.frombuffer(b"".join(table.get(i, b"") for i in range(max(table) + 1)), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(table.get(i, b"")) for i in range(max(table) + 1)])])
        self.pattern = regex.compile(PATTERN)
        self.unknown = _unknown_letters()
        self.border = regex.compile(r"(?<=\S)\s")
        self.stop = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = _Remembered(self)

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for k, b in enumerate(self.bytes_of):
            out.add_word(b.decode("latin-1"), k)
        out.make_automaton()
        return out

    def longest(self, text: str, at: int) -> int:
        """The longest token that begins at ``at``."""
        n = at + self.automaton.longest_prefix(text[at:at + self.most])   # a prefix of some token
        while (k := self.number.get(text[at:n])) is None:
            n -= 1
        return k

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one pre-token (int32 bytes)."""
        text = piece.encode().decode("latin-1")
        taken = [k for _, k in self.automaton.iter_long(text)]   # always the longest match
        if not all(map(self.pairs.__getitem__, zip(taken, taken[1:], strict=False))):
            taken = self._backtracked(text)
        return b"".join(map(self.packed.__getitem__, taken))

    def _backtracked(self, text: str) -> list[int]:
        taken, pairs, size = [], self.pairs, self.size
        dead = set()                                    # places from which no way leads on
        at, k = 0, self.longest(text, 0)
        while at < len(text):
            while k >= 0 and (at + size[k] in dead or taken and not pairs[taken[-1], k]):
                k = self.shorter[k]
            if k >= 0:
                taken.append(k)
                at += size[k]
                k = self.longest(text, at) if at < len(text) else -1
            else:                                       # take the last token back and try a shorter one
                dead.add(at)
                k = taken.pop()
                at -= size[k]
        return taken

    def pieces(self, text: str):
        """Lists of pre-tokens of a text without special tokens, slice by slice; a slice ends
        where white space follows another character, which no pre-token spans."""
        at = 0
        while at < len(text):
            cut = self.border.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.start() if cut else len(text)
            part = text[at:end] if at or end < len(text) else text
            if not part.isascii() and self.unknown.search(part):
                yield [part[m.start():m.end()] for m in self.pattern.finditer(self.unknown.sub(OTHER, part))]
            else:
                yield self.pattern.findall(part)
            at = end

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text (int32)."""
        out = []
        for part in self.stop.split(text) if self.stop else [text]:
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
            else:
                out += (b"".join(map(self.cache.__getitem__, pieces)) for pieces in self.pieces(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered by the offset table."""
        size = self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offset[ids] - (ends - size), size)
        return self.blob[place].tobytes()


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _mapped(df: DataFrame, path: str, rows, fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    kind = dict(df.dtypes)["doc_id"]

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                raw = data.tobytes()
                got = [rows(tok, raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array([g[k] for g in got], t) for k, (_, t) in enumerate(fields))],
                    ["doc_id", *(n for n, _ in fields)])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {ddl}")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs (doc_id, text)`` with the tokenizer file ``path``.

    Special tokens' strings in a text become their ids, none is added, nothing is cut off. A
    null or empty text has no ids. Repeated rows and rows without doc_id are encoded like
    any other; other columns are ignored. Nothing is shuffled.
    """
    return _mapped(docs, path, lambda tok, text: (tok.encode(text),), [("ids", pa.list_(pa.int32()))], "ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids)``; null ids give an empty text."""

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            texts = [tok.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(ids.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: :func:`encoded` and its decoded text in one pass over the texts."""
    def rows(tok, text):
        ids = tok.encode(text)
        return ids, tok.decode(ids).decode("utf-8", "replace")

    return _mapped(docs, path, rows, [("ids", pa.list_(pa.int32())), ("decoded", pa.string())], "ids array<int>, decoded string")


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns, from the rows of :func:`round_trip`."""
    return round_trip(docs, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
