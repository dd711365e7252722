"""Alignment of two tokenizers against brute force on token intervals, and the encoders' edge texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_support import docs_of, few_partitions, sentences  # noqa: F401
from tokenizers import Tokenizer

from issuegrid.llm import align, ordinary

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


TEXTS = [None, "", " ", "a", "hello  world", "a▁b", "<s> x </s> <|endoftext|>", "\x00\x01\t\n", "é́ ﬁ 𝒳 中文字 🙂🙂", "don't we'll", "x" * 3000, " " * 5000 + "a", "b" + "\n" * 2500,
         "<0x41> 12345 67", "﻿bom ​", "naïve Straße ÇA", "tab\tand  two", "0.5%,;:!?" * 40] + sentences(3, 30)


def brute(texts, libraries):
    a_lib, b_lib = libraries
    letters = {v: k for k, v in __import__("issuegrid.llm.bpe", fromlist=["x"])._byte_letters().items()}
    letter_byte = {v: k for k, v in letters.items()}
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        whole = (" " + text).encode()
        ids_a, ids_b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        bytes_a = [bytes(letter_byte[c] if c in letter_byte else 0 for c in a_lib.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append(None)
            continue
        at_a, at_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        both, groups, x, y = sorted(set(at_a) & set(at_b)), [], 0, 0
        for cut in both:
            i, j = at_a.index(cut) + 1, at_b.index(cut) + 1
            groups.append((ids_a[x:i], ids_b[y:j]))
            x, y = i, j
        ends_b = {e: k for k, e in enumerate(at_b)}
        links = [(ids_a[k], ids_b[ends_b[e]]) for k, e in enumerate(at_a) if e in ends_b]
        docs.append((ids_a, ids_b, groups, links))
    n = Counter(x for d in docs if d for x in d[3])
    best = defaultdict(int)
    for (_, b), c in n.items():
        best[b] = max(best[b], c)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in d[2])
            out.append((len(d[0]), len(d[1]), len(d[2]), len(d[3]), sum(n[x] == best[x[1]] for x in d[3]), sum(n[x] for x in d[3]), hashlib.sha256(said.encode()).hexdigest()))
    return out


def test_digest_matches_brute_force(spark, docs_of, libraries, monkeypatch):
    texts = TEXTS + TEXTS[4:9] * 3
    got = align.alignment_digest(docs_of(list(enumerate(texts))).repartition(3), A, B).collect()
    expect = brute(texts, libraries)
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == expect[r.doc_id], texts[r.doc_id]
    assert sum(e[0] > 0 for e in expect) > 30 and sum(e[0] == 0 for e in expect) >= 3


def test_alignment_arrays(spark, docs_of, libraries):
    got = {r.doc_id: r for r in align.alignments(docs_of(list(enumerate(TEXTS))).repartition(2), A, B).collect()}
    p = align.pairing(A, B)
    for k, text in enumerate(TEXTS):
        r = got[k]
        if not r.ids_a:
            assert not r.ids_b and not r.overlap_a and not r.group_a
            continue
        end_a, end_b = np.cumsum(p.size_a[r.ids_a]), np.cumsum(p.size_b[r.ids_b])
        a = list(zip([0, *end_a[:-1].tolist()], end_a.tolist(), strict=True))
        b = list(zip([0, *end_b[:-1].tolist()], end_b.tolist(), strict=True))
        if len(a) < 500:
            assert list(zip(r.overlap_a, r.overlap_b, strict=True)) == [(i, j) for i, (s, e) in enumerate(a) for j, (u, v) in enumerate(b) if s < v and u < e], text
        cuts = np.intersect1d(end_a, end_b)
        assert r.group_a == np.searchsorted(cuts, end_a).tolist() and r.group_b == np.searchsorted(cuts, end_b).tolist()


def test_possible_pairs_hold_every_link():
    p = align.pairing(A, B)
    assert len(p.keys) == 324_297 and (np.diff(p.keys) > 0).all()


def test_edges(spark, docs_of):
    assert align.alignment_digest(docs_of([]), A, B).collect() == []
    got = align.alignment_digest(docs_of([(None, "a b"), (None, None), (7, "a b")]), A, B).collect()
    assert sorted((r.doc_id or -1, r.n_a, r.n_links, r.n_best) for r in got) == [(-1, 0, 0, 0), (-1, 2, 2, 2), (7, 2, 2, 2)]


@pytest.mark.parametrize("space", [" ", "\n", "　", " \t"])
def test_ordinary_encoder_equals_the_library(libraries, space, monkeypatch):
    p = align.pairing(A, B)
    monkeypatch.setattr(ordinary, "_SPACES", ordinary.re.compile(ordinary._SPACES.pattern.replace(str(ordinary.LONG_SPACE), "3")))
    for text in ["x" + space * n + y for n in range(1, 9) for y in ("", "x", "'s", "1", "!", "՘", " ")] + [space * 7, space * 3 + "a" + space * 4 + "b" + space * 2]:
        assert p.encode_a(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids, repr(text)
    monkeypatch.undo()
    long = "a" + space * 600_000 + "b"
    assert p.encode_a(long).tolist() == libraries[0].encode(long, add_special_tokens=False).ids
