"""Contamination against brute force, with short items, several automata and edge rows."""

import hashlib
import random
import re

import pytest
from llm_support import docs_of, few_partitions, lower, sentences  # noqa: F401

from issuegrid.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    ids |= windows[tuple(w[k:k + n])]
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [100_000, 90])
def test_matches_brute_force(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    r = random.Random(2)
    texts = sentences(6, 12, 30, 60)
    items = [(k, t) for k, t in enumerate(texts)] + [(20, "short one here"), (21, "x"), (22, ""), (23, None), (24, "!!"), (3, "a second text of item three"),
             (None, "an item without id"), (25, " ".join(sentences(8, 6, 40, 30)))]
    rows = [(0, None), (1, ""), (2, "X"), (2, "X"), (None, "says Short, ONE-here twice: short one here"), (4, texts[0]), (5, "an item without id x")]
    for k in range(40):
        w = " ".join(sentences(50 + k, 1, r.randint(5, 400), 60)).split()
        cut = texts[r.randrange(12)].split()
        a = r.randrange(len(cut))
        w[r.randrange(len(w)):0] = cut[a:a + r.randint(10, 25)]
        rows.append((10 + k, " ".join(w).upper() if k % 3 else ",\n".join(w)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contamination_digest(docs_of(rows), bench).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, items), key=str)


def test_removed_stretches(spark, docs_of):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    judged = decontam.contamination(docs_of([(1, "One Alpha, beta gamma; two é"), (2, "one two"), (3, "alpha beta")]), bench)
    assert {r.doc_id: r.hits for r in judged.collect()} == {1: [4, 21], 2: [], 3: []}
    assert {r.doc_id: r.text for r in decontam.without_hits(judged, False).collect()} == {1: "One ; two é", 2: "one two", 3: "alpha beta"}
    assert {r.doc_id for r in decontam.without_hits(judged).collect()} == {2, 3}


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[:4] for r in decontam.contamination_digest(docs_of([(1, "a b")]), none).collect()] == [(1, 2, 0, 0)]
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontam.contamination_digest(docs_of([]), some).collect() == []
