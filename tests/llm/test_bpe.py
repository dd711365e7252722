"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Reference

from llm_support import docs_of, few_partitions  # noqa: F401

from issuegrid.llm import bpe
from issuegrid.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
REFERENCE, MINE = Reference.from_file(PATH), bpe.Tokenizer(PATH)


def same(text):
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    assert MINE.encode(text).tolist() == ids
    assert MINE.decode(MINE.encode(text)).decode("utf-8", "replace") == REFERENCE.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_crafted_texts():
    r = random.Random(3)
    parts = [" ", "\n", "\t", "'s", "'", "tion", "the", "ABC", "é", "漢", "🙂", "123", "<|endoftext|>", "aaaa", "\u00a0", "...", "zqx"]
    for _ in range(3000):
        same("".join(r.choice(parts) for _ in range(r.randint(0, 25))))


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"!{c}'s 1{c}" for c in points]
    for k in range(0, len(texts), 100_000):
        some = texts[k:k + 100_000]
        for text, e in zip(some, REFERENCE.encode_batch(some, add_special_tokens=False), strict=True):
            assert MINE.encode(text).tolist() == e.ids, ascii(text)


def test_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    r = random.Random(5)
    same("".join(r.choice(["word", " ", "  ", "\n", "it's", "漢字"]) for _ in range(2000)))
    same("x" * 3000 + " " * 300 + "y")


def test_small_caches(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    same("the quick brown fox jumps over the lazy dog the quick brown fox " * 3)


def test_rows(docs_of):
    rows = [(1, "Hello <|endoftext|> world"), (1, "Hello <|endoftext|> world"), (2, None), (3, ""), (None, "naïve")]
    got = bpe.round_trip_digest(docs_of(rows), PATH).collect()
    expect = []
    for i, t in rows:
        ids = REFERENCE.encode(t or "", add_special_tokens=False).ids
        expect.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expect, key=str)
    coded = bpe.encoded(docs_of(rows), PATH)
    assert sorted((r.text for r in bpe.decoded(coded, PATH).collect())) == sorted((t or "") for _, t in rows)
    assert bpe.round_trip_digest(docs_of([]), PATH).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Tokenizer(tokenizer_path("word_bpe_49k.json"))
