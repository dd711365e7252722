"""Source divergence against a brute-force version: blocks, nulls, ties, long texts, empty tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_support import few_partitions, lower, sentences  # noqa: F401

from issuegrid.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, value double, block int, number int, p int, total string"


def table(spark, rows):
    return spark.createDataFrame([(k, t, g, s, "x", 0.5, 1, 2, 3, "y") for k, (t, g, s) in enumerate(rows)], SCHEMA)


def brute(rows, least, top=50):
    held, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups.add((lang, source))
        held[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        every = Counter()
        for g, s in groups:
            if g == lang:
                every.update(count[g, s])

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = share(count[lang, source]), share(every)
        pairs = []
        for g, s in groups:
            if g == lang and s != source:
                r = share(count[g, s])
                pairs.append((-sum(abs(p[t] - r[t]) for t in kept), s.encode(), s))
        terms = [(q[t] - p[t], t.encode(), t) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("blocks", [(32, 1024), (2, 5), (1, 1)])
def test_divergence_matches_brute_force(spark, blocks):
    r = random.Random(5)
    texts = sentences(7, 150, words=30, vocabulary=60)
    rows = [(t, r.choice(["en", "de", None]), r.choice(["a", "b", "ä", "Z", "", None, "hot", "hot", "hot"])) for t in texts]
    rows += rows[:9] * 3 + [("", "en", "void"), (None, "en", "null"), ("12 34!", "xx", "alone"), ("Éa éa AB ab aB", "fr", "s1"), ("éa", "fr", "s2")]
    rows += [("one two", "solo", "only")] * 4
    for least in (3, 30):
        assert got(divergence.source_divergence(table(spark, rows), least, 5, *blocks)) == brute(rows, least, 5)


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    rows = [(" ".join(sentences(k, 30)), "en", f"s{k % 3}") for k in range(6)] + [("x" * 9000 + " y", "en", "s0"), ("y " * 5000, "en", "s1")]
    whole = brute(rows, 2)
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 700)
    for text, _, _ in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        pieces = list(divergence._pieces(data))
        assert b"".join(p.tobytes() for p in pieces).decode() == text
        parts = Counter()
        for p in pieces:
            terms, codes, _ = divergence._occurrences(p, np.array([0, len(p)]))
            parts.update(dict(zip(terms.to_pylist(), np.bincount(codes, minlength=len(terms)).tolist(), strict=True)))
        assert parts == Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
    monkeypatch.undo()
    long = [(t * (5_000_000 // len(t)) if k == 0 else t, g, s) for k, (t, g, s) in enumerate(rows)]
    assert got(divergence.source_divergence(table(spark, rows), 2)) == whole
    assert got(divergence.source_divergence(table(spark, long), 2)) == brute(long, 2)


def test_empty_table(spark):
    assert divergence.source_divergence(table(spark, [])).collect() == []
