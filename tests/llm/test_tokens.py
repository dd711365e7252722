"""Unigram counts against the tokenizers library; packing against a linear search."""

import random

import numpy as np
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer, models

from llm_support import docs_of, few_partitions  # noqa: F401

from issuegrid.llm import packing, tokencount
from issuegrid.llm.queries import tokenizer_path

PATH, RANKS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.tiktoken")


def reference():
    model = pb.ModelProto()
    model.ParseFromString(SentencePieceProcessor(model_file=PATH).serialized_model_proto())
    return Tokenizer(models.Unigram([(p.piece, p.score if p.type in (1, 4) else -1e9) for p in model.pieces], unk_id=0, byte_fallback=True))


def expected(ref, t):
    return len(ref.encode("▁" + t.replace(" ", "▁")).ids) if t else 0


def test_counts_match_the_unigram_model():
    ref, mine, r = reference(), tokencount.counter(PATH), random.Random(8)
    parts = [" ", "  ", "a", "th", "ing", "é", "漢", "🙂", "\n", ".", "the", "x", "zq", "1", "\u0001", "▁"]
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert mine.count(t) == expected(ref, t), t


def test_count_rows(docs_of):
    ref, rows = reference(), [(1, "some words"), (1, "some words"), (None, "x"), (2, None), (3, "")]
    got = tokencount.token_counts(docs_of(rows), PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, len(t or ""), expected(ref, t or "")) for i, t in rows), key=str)
    assert tokencount.token_counts(docs_of([]), PATH).collect() == []


def test_ties_take_the_piece_that_begins_first():
    c = tokencount.Counter({"a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "abc": -3.0})
    assert c.best("abc") == (-3.0, 1)
    assert tokencount.Counter({"a": -1.0, "aa": -2.0}).best("aaa") == (-3.0, 2)


def test_best_fit_matches_linear_search():
    r = np.random.default_rng(4)
    for size in (1, 7, 64):
        sizes = r.integers(1, size + 1, 300)
        rows = packing.best_fit_decreasing(sizes, size)
        assert sorted(k for row in rows for k in row) == list(range(300))
        room = []                                        # the same by looking at every row
        for n in sorted(sizes.tolist(), reverse=True):
            fit = [x for x in range(len(room)) if room[x] >= n]
            if fit:
                room[min(fit, key=lambda x: room[x])] -= n
            else:
                room.append(size - n)
        assert sorted(size - sum(int(sizes[k]) for k in row) for row in rows) == sorted(room)


def test_packed_rows_are_lossless(docs_of):
    encode, r = packing.encoder(RANKS), random.Random(6)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "<|endoftext|>", "漢字"]) for _ in range(r.randint(0, 60)))) for k in range(60)] + [(100, None), (101, ""), (102, " " * 1_000_000), (103, "a" + "\n" * 300_000 + "b")]
    got, back = packing.packed_rows(docs_of(rows), RANKS, 32).collect(), {}
    assert len({x.seq_id for x in got}) == len(got)
    for x in got:
        ids, places = np.frombuffer(x.ids, np.uint32), np.frombuffer(x.positions, np.uint32)
        assert len(ids) == len(places) == 32 and x.cu_seqlens[0] == 0 and x.cu_seqlens[-1] == x.n_tokens
        assert not ids[x.n_tokens:].any()
        for d, o, a, b in zip(x.doc_ids, x.offsets, x.cu_seqlens, x.cu_seqlens[1:], strict=False):
            assert places[a:b].tolist() == list(range(b - a))
            back[d, o] = ids[a:b].tolist()
    for d, t in rows:
        assert sum((back[k] for k in sorted(k for k in back if k[0] == d)), []) == (encode(t).tolist() if t else [])
    assert packing.packed_rows(docs_of([]), RANKS).collect() == []


def test_written_rows_read_back(spark, docs_of, tmp_path):
    rows = packing.packed_rows(docs_of([(1, "alpha beta")]), RANKS, 16)
    packing.write_packed(rows, str(tmp_path / "packed"))
    assert [bytes(r.ids) for r in spark.read.parquet(str(tmp_path / "packed")).collect()] == [bytes(r.ids) for r in rows.collect()]
