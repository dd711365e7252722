"""Removed bytes against brute force over all 100-byte strings."""

import hashlib
import random

import pytest
from llm_support import docs_of, few_partitions, sentences  # noqa: F401

from issuegrid.llm import substrings


def brute(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k:k + length] in seen:
                hit[k:k + length] = b"\1" * length
            seen.add(b[k:k + length])
        kept = bytes(x for x, m in zip(b, hit, strict=True) if not m)
        out[i] = (len(b), sum(hit), sum(hit[k] and not (k and hit[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    r, rows = random.Random(7), []
    base, line, passage = sentences(11, 6, 80), "the same line for everyone: 0123456789 abcdefghij", " ".join(sentences(12, 1, 30))
    for k in range(60):
        t = base[k % 6] if k % 4 == 0 else " ".join(sentences(100 + k, 1, 60))
        if k % 3 == 0:
            t = line + "\n" + t
        if k % 5 == 0:
            a = r.randrange(len(t))
            t = t[:a] + passage + t[a:]
        if k % 7 == 0:
            t = t.replace("a", "é")
        rows.append((k * 3, t))
    rows += [(500, "ab" * 200), (501, "a" * 99), (502, "a" * 100), (503, "a" * 101), (504, ""), (505, "é漢🙂" * 60)]
    return rows


@pytest.mark.parametrize("crowd", [16, 0])
def test_matches_brute_force(docs_of, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rows = corpus()
    random.Random(1).shuffle(rows)
    got = substrings.repeated_substrings_digest(docs_of(rows).repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows)


def test_long_text_over_several_segments(docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 500)
    text = " ".join(sentences(21, 4, 100))
    rows = [(1, text), (2, "x" + text[300:1500] + "y" + text[:700])]
    got = substrings.repeated_substrings_digest(docs_of(rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows)


def test_repeated_rows_null_ids_empty(docs_of):
    t = " ".join(sentences(31, 1, 60))
    got = substrings.repeated_substrings(docs_of([(7, t), (7, t), (None, t), (9, None)]), carry=("d", "kept")).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, len(r[3])) for r in got) == [(-1, len(t), len(t)), (7, len(t), 0), (7, len(t), 0), (9, 0, 0)]
    assert substrings.repeated_substrings_digest(docs_of([])).collect() == []


@pytest.mark.parametrize("length", [40, 400])
def test_other_lengths(docs_of, length):
    text, other = " ".join(sentences(41, 8, 100)), " ".join(sentences(42, 4, 100))
    rows = [(1, text), (2, "x" + text[300:2500] + "y" + other), (3, other[:700] + text[900:1800] + other[500:])]
    got = substrings.repeated_substrings(docs_of(rows), length=length).collect()
    spans = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, hashlib.sha256(r.kept).hexdigest()) for r in got}
    assert spans == brute(rows, length)


def test_length_below_a_gram(docs_of):
    with pytest.raises(ValueError, match="at least 32"):
        substrings.repeated_substrings(docs_of([]), length=31)


def test_whole_characters(docs_of):
    t = "é" * 80
    got = substrings.repeated_substrings(docs_of([(1, t), (2, "è" + t[:60] + "ô")]), whole_characters=True).collect()
    assert {r.doc_id: bytes(r.kept).decode() for r in got}[2] == "èô"
