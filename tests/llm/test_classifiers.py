"""Held-out accuracy, gradients and edge rows of the trained operators."""

import zlib

import numpy as np
import pytest
from llm_support import SF_LARGE, docs_of, few_partitions, sentences  # noqa: F401

from issuegrid.llm import quality, toxicity


@pytest.mark.parametrize("scores,label,least", [(quality.quality_scores, "quality", 0.95), (toxicity.toxicity_scores, "toxic", 0.9)])
def test_held_out_accuracy(spark, scores, label, least):
    docs, labels = spark.read.parquet(f"{SF_LARGE}/documents.parquet"), spark.read.parquet(f"{SF_LARGE}/labels.parquet")
    docs = docs.join(labels, "doc_id", "left_semi")
    out = scores(docs, labels)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    mod, fold = (3, 1) if label == "quality" else (5, 0)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % mod == fold) for i, r in rows.items())
    test = [(rows[x.doc_id].predicted, x[label]) for x in labels.collect() if rows[x.doc_id].held_out]
    assert np.mean([p == y for p, y in test]) >= least
    assert np.mean([p for p, y in test if y == 1]) > np.mean([p for p, y in test if y == 0]) + 0.4


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_edge_rows(spark, docs_of, scores):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "some words here"), (5, "word " * 30_000), (6, "!!! ???")]
    for labels in ([], [(3, 1, 1)], [(3, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (3, 0, 0)]):
        got = scores(docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
        assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 2, 3, 3, 5, 6]
        assert all(0 <= r.score <= 1 for r in got)
        by = {r.doc_id: r.score for r in got}
        assert by[1] == by[2]
    assert scores(docs_of([]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []


def test_statistics():
    data = "AB ab, 9\nab é é".encode()
    row = dict(zip(quality.STATISTICS, quality.text_statistics(np.frombuffer(data, np.uint8), np.array([0, len(data), len(data)]))[0], strict=True))
    n = len(data)
    assert row["upper"] == 2 / n and row["digit"] == 1 / n and row["punct"] == 1 / n and row["high"] == 4 / n and row["space"] == 5 / n
    assert row["words"] == 6 and row["distinct"] == 4 / 6 and row["top_word"] == 2 / 6 and row["same_as_last"] == 1 / 6 and row["lines"] == 2
    empty = quality.text_statistics(np.frombuffer(data, np.uint8), np.array([0, n, n]))[1]
    assert not empty.any()


def test_rules_find_a_conjunction_and_compile(spark):
    r = np.random.default_rng(3)
    x = r.random((600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.6)).astype(float)
    base, rules = quality.fit_rules(x, y)
    named = dict(zip(quality.STATISTICS, x.T, strict=True))
    total = base + sum(w * rule.holds(named) for rule, w in rules)
    assert np.mean((total >= 0) == y) > 0.97 and len(rules) < 80
    df = spark.createDataFrame(x[:50].tolist(), quality.STATISTICS)
    got = [r.s for r in df.select(quality.score_column(base, rules).alias("s")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total[:50])))


def test_windows_cover_every_word():
    first = np.cumsum([0, 0, 1, 31, 32, 33, 48, 49, 500])
    text, at, size = toxicity.windows(first)
    for t in range(8):
        covered = {w for k in np.flatnonzero(text == t) for w in range(at[k], at[k] + size[k])}
        assert covered == set(range(first[t], first[t + 1]))
    assert size.max() == toxicity.WINDOW


def test_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "_F", np.float64)
    r = np.random.default_rng(5)
    p = {k: v.astype(float) for k, v in toxicity.initial(np.arange(6), r.normal(0, 1, 6)).items()}
    x = r.normal(0, 1, (50, toxicity.WORD + toxicity.CHAR))
    index, mask = toxicity._index(np.array([0, 10, 45]), np.array([32, 20, 5]))
    weight = np.array([0.3, -0.7, 1.1])
    loss = lambda: float(weight @ toxicity._forward(p, x, index, mask))
    kept = []
    toxicity._forward(p, x, index, mask, kept)
    grad, dx = toxicity._backward(p, x, index, mask, kept, weight)
    for name, array, g in [*((k, p[k], grad[k]) for k in grad), ("inputs", x, dx)]:
        for place in [tuple(r.integers(0, s) for s in array.shape) for _ in range(4)]:
            old = array[place]
            array[place] = old + 1e-5
            up = loss()
            array[place] = old - 1e-5
            down = loss()
            array[place] = old
            assert abs((up - down) / 2e-5 - g[place]) < 1e-4, name


def test_one_bad_word_in_a_long_text_is_found():
    texts = sentences(41, 400, 60)
    labels = np.array([k % 4 == 0 for k in range(400)], float)
    texts = [t.replace(" ", " dreadful ", 1) if y else t for t, y in zip(texts, labels, strict=True)]
    model = toxicity.train(texts, labels)
    clean = " ".join(sentences(42, 30, 60))
    for text, toxic in ((clean, False), (clean[:5000] + " DREADFUL " + clean[5000:], True)):
        raw = text.encode()
        assert (toxicity.text_logits(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] > 0) == toxic


def test_training_sample_is_bounded_in_rows_and_bytes(spark):
    from issuegrid.llm.labelled import held_out, training_rows

    docs = spark.createDataFrame([(7, f"text {k:04d}") for k in range(3000)] + [(k, "x" * 100) for k in range(100, 160)] + [(8, None), (None, "y")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in (7, 8, *range(100, 160))] + [(7, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    known = {r.doc_id for r in labels.where("doc_id is not null and toxic is not null").where(~held_out(5, 0)).collect()}
    sample = training_rows(docs, labels, "toxic", 5, 0, 1000).collect()
    assert sorted(r.doc_id for r in sample) == sorted(known)              # a repeated doc_id is one row
    assert {r.doc_id: (r.text, r.label) for r in sample}.get(7, ("text 0000", 1)) == ("text 0000", 1)
    assert len(training_rows(docs, labels, "toxic", 5, 0, 10).collect()) == 10
    few = training_rows(docs, labels, "toxic", 5, 0, 1000, max_bytes=1000).collect()
    assert 9 <= len(few) < len(sample) and sum(len(r.text) for r in few) <= 1000
