"""Quality classifier: a sparse ensemble of rules (operator 5).

Statistics of a text (shares of byte classes, repetition of words and lines, lengths) are
computed in numpy over Arrow batches. Small boosted trees over a bounded labelled sample
propose rules - the conjunction of conditions on the way to each node - and a logistic
regression with an L1 penalty keeps few of them. The kept rules are compiled into one
Spark column expression, which scores every document.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, training_rows
from .text import LOWER, SPACED_WORD, byte_set, prefix_hash, quoted, span_hash, text_chunks, word_spans

#: Labelled rows that the classifier is fitted on at most.
TRAIN_ROWS = 8000
TREES, DEPTH, BINS = 40, 3, 32

_CLASSES = {
    "upper": byte_set(range(0x41, 0x5B)),
    "digit": byte_set(range(0x30, 0x3A)),
    "punct": byte_set(b".,;:!?'\"()-"),
    "symbol": byte_set(b"#$%&*+/<=>@[\\]^_`{|}~"),
    "bang": byte_set(b"!?"),
    "space": ~SPACED_WORD,
    "high": byte_set(range(0x80, 0x100)),
}
STATISTICS = [*_CLASSES, "words", "word_length", "distinct", "top_word", "same_as_last", "lines", "distinct_lines", "line_length"]


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _repeats(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the count of the commonest one, per text."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(text[order].astype(np.uint32), kind="stable")]
    text, h = text[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])]))
    count = np.diff(np.append(new, len(h)))
    distinct = np.bincount(text[new], minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, text[new], count)
    return distinct, top


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of :data:`STATISTICS` for every text of a chunk (zeros for an empty text)."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    out = [_per_text(t[data], offsets) / size for t in _CLASSES.values()]
    h = prefix_hash(LOWER[data])
    starts, ends, first = word_spans(data, offsets, SPACED_WORD)
    words, wh = np.diff(first), span_hash(h, starts, ends)
    text = np.repeat(np.arange(n), words)
    distinct, top = _repeats(text, wh, n)
    same = np.zeros(len(wh), bool)
    same[1:] = (wh[1:] == wh[:-1]) & (text[1:] == text[:-1])
    some = np.maximum(words, 1)
    out += [words.astype(float), _per_text(ends - starts, first) / some, distinct / some, top / some, _per_text(same, first) / some]
    starts, ends, first = word_spans(data, offsets, ~byte_set(b"\n"))
    lines = np.diff(first)
    distinct, _ = _repeats(np.repeat(np.arange(n), lines), span_hash(h, starts, ends), n)
    some = np.maximum(lines, 1)
    out += [lines.astype(float), distinct / some, _per_text(ends - starts, first) / some]
    return np.stack(out, 1)


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns of every row as one struct ``kept`` (so no name can clash), and its
    :data:`STATISTICS` as double columns."""
    rows = docs.select(F.struct(*quoted(keep)).alias("kept"), "text")
    schema = T.StructType([T.StructField("kept", rows.schema["kept"].dataType), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                stats = text_statistics(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(np.ascontiguousarray(s)) for s in stats.T)], ["kept", *STATISTICS])

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(statistic, above?, threshold)``; above means ``>``, else ``<=``."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[s] > t if up else x[s] <= t for s, up, t in self.conditions])

    def column(self) -> Column:
        return functools.reduce(Column.__and__, [F.col(s) > t if up else F.col(s) <= t for s, up, t in self.conditions])


def _tree(binned: np.ndarray, grad: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple):
    """``(path, rows)`` of a greedy least-squares tree's nodes below its root."""
    if depth == 0 or len(rows) < 20:
        return
    best, total, n = (1e-9, 0, 0), grad[rows].sum(), len(rows)
    for f in range(binned.shape[1]):
        count = np.cumsum(np.bincount(binned[rows, f], minlength=BINS))[:-1]
        left = np.cumsum(np.bincount(binned[rows, f], grad[rows], BINS))[:-1]
        fit = (count >= 5) & (n - count >= 5)
        gain = np.where(fit, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
        best = max(best, (gain.max(), f, int(gain.argmax())))
    gain, f, b = best
    if gain <= 1e-9:
        return
    for up in (False, True):
        part = rows[(binned[rows, f] > b) == up]
        here = (*path, (STATISTICS[f], up, float(cuts[f][b])))
        yield here, part
        yield from _tree(binned, grad, cuts, part, depth - 1, here)


def _simplest(path: tuple) -> tuple:
    """Conditions with the tightest threshold for each statistic and side, in a fixed order."""
    tight: dict = {}
    for s, up, t in path:
        tight[s, up] = t if (s, up) not in tight else (max if up else min)(tight[s, up], t)
    return tuple((s, up, t) for (s, up), t in sorted(tight.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules for labels ``y`` (0/1) of rows ``x`` of statistics.

    With no rows, or labels of one kind, there are no rules and the intercept alone speaks.
    """
    base = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return float(np.log(base / (1 - base))), []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)   # bin > b means value > cuts[b]
    cuts = [np.append(c, np.full(BINS - len(c), np.inf)) for c in cuts]
    raw, found = np.full(len(y), np.log(base / (1 - base))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        nodes = list(_tree(binned, y - p, cuts, np.arange(len(y)), DEPTH, ()))
        for path, rows in nodes:
            found[Rule(_simplest(path))] = None
            if len(path) == DEPTH or not any(q[:len(path)] == path and len(q) > len(path) for q, _ in nodes):
                raw[rows] += 0.3 * (y[rows] - p[rows]).sum() / ((p[rows] * (1 - p[rows])).sum() + 1)
    named = dict(zip(STATISTICS, x.T, strict=True))
    rules = [r for r in found if all(np.isfinite(t) for _, _, t in r.conditions)]
    a = np.stack([r.holds(named) for r in rules], 1).astype(float)
    w, b = np.zeros(a.shape[1]), np.log(base / (1 - base))
    z, t = w.copy(), 1.0
    step = 4 * len(y) / (np.linalg.norm(a, 2) ** 2 + len(y))
    for _ in range(1500):                                  # accelerated proximal gradient steps
        g = (1 / (1 + np.exp(-(a @ z + b))) - y) / len(y)
        new = z - step * (a.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= step * g.sum()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (last - 1) / t * (new - w), new
    return float(b), [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6]


def score_column(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The ensemble's probability as one Spark expression over the statistics."""
    total = functools.reduce(Column.__add__, [F.when(r.column(), w).otherwise(0.0) for r, w in rules], F.lit(intercept))
    return 1 / (1 + F.exp(-total))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Column:
    """:func:`score_column` of rules fitted on at most ``rows`` labelled documents (those whose
    crc32(doc_id) mod 3 is not 1)."""
    sample = with_statistics(training_rows(docs, labels, "quality", 3, 1, rows), "doc_id", "label").select("kept.*", *STATISTICS).toPandas()
    sample = sample.sort_values("doc_id", kind="stable")
    return score_column(*fit_rules(sample[STATISTICS].to_numpy(float), sample["label"].to_numpy(float)))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs (doc_id, text)``.

    A null text counts as empty and is scored like one; repeated rows and rows without
    doc_id are scored like any other (a null doc_id is not held out); other columns are not
    looked at. Without labels every score is the prior 0.5. Nothing but the bounded sample
    leaves the tasks.
    """
    return with_statistics(docs, "doc_id").select("kept.doc_id", *STATISTICS).select(
        "doc_id", held_out(3, 1).alias("held_out"), fitted(docs, labels, rows).alias("score")).select(
        "*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
