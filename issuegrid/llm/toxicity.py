"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 1).

A word's input is its vocabulary embedding (one shared vector for words outside the
vocabulary) beside the mean embedding of its bytes. Every text is cut into overlapping
windows of words; a window goes through a forward and a backward GRU, attention pools the
states, and a logistic unit scores it; the document's score is its highest window. The
network is trained in numpy on a bounded labelled sample: a document's loss is that of
its highest window. Scoring runs over all windows of all texts inside Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows
from .text import LOWER, PLAIN_WORD, prefix_hash, span_hash, text_chunks, word_spans

#: Labelled rows that the network is trained on at most.
TRAIN_ROWS = 4000
WINDOW, STRIDE = 32, 16
WORD, CHAR, HIDDEN = 8, 4, 8
LEAST_SEEN, VOCABULARY = 5, 30_000
STEPS, BATCH, RATE = 250, 64, 0.02
_F = np.float32


def _words(data: np.ndarray, offsets: np.ndarray):
    """Hashes, starts and ends of a chunk's words, and each text's first word."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, PLAIN_WORD)
    return span_hash(prefix_hash(low), starts, ends), starts, ends, first


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, first word, words)`` of all windows: a text of up to ``WINDOW`` words is one,
    a longer one has a window every ``STRIDE`` words up to its end; no words, no window."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(-(-(n - WINDOW) // STRIDE), 0), 0)
    text = np.repeat(np.arange(len(n)), count)
    at = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, first[:-1][text] + at, np.minimum(n[text] - at, WINDOW)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def initial(vocabulary: np.ndarray, prior: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters before training. ``prior``: a word's smoothed log-odds, which its embedding starts with."""
    r = np.random.default_rng(seed)
    d = WORD + CHAR
    p = {"word": r.normal(0, 0.1, (len(vocabulary) + 1, WORD)), "char": r.normal(0, 0.1, (256, CHAR)),
         "attend": r.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "focus": r.normal(0, 0.3, HIDDEN), "out": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.full(1, -2.0)}
    p["word"][:-1, 0] += prior
    for k in "fb":                                     # gates: update, reset, candidate
        p |= {f"x{k}": r.normal(0, 0.4, (d, 3 * HIDDEN)), f"h{k}": r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"c{k}": np.zeros(3 * HIDDEN)}
    return {k: v.astype(_F) for k, v in p.items()}


def _states(p, k, proj, index, mask, keep=None):
    """States of direction ``k`` after each step, ``(steps, windows, HIDDEN)``; ``keep`` collects what backward needs."""
    h = np.zeros((index.shape[0], HIDDEN), _F)
    out = np.empty((WINDOW, *h.shape), _F)
    w = p[f"h{k}"]
    for t in range(WINDOW) if k == "f" else range(WINDOW - 1, -1, -1):
        a = proj[index[:, t]]
        zr = _sigmoid(a[:, :2 * HIDDEN] + h @ w[:, :2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(a[:, 2 * HIDDEN:] + (r * h) @ w[:, 2 * HIDDEN:])
        new = h + mask[:, t:t + 1] * z * (c - h)       # a window's missing words leave the state as it is
        if keep is not None:
            keep.append((t, h, z, r, c))
        out[t] = h = new
    return out


def _forward(p, x, index, mask, keep=None):
    """Logits of windows given as word places ``index`` into the inputs ``x``."""
    fwd, bwd = ([], []) if keep is not None else (None, None)
    s = np.concatenate([_states(p, k, x @ p[f"x{k}"] + p[f"c{k}"], index, mask, q) for k, q in (("f", fwd), ("b", bwd))], 2)
    u = np.tanh(s @ p["attend"])
    e = np.where(mask.T > 0, u @ p["focus"], _F(-1e9))
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    pooled = (e[:, :, None] * s).sum(0)
    if keep is not None:
        keep += [s, u, e, pooled, fwd, bwd]
    return pooled @ p["out"] + p["bias"][0]


def _inputs(p, place, data, starts, ends):
    """Inputs of words: vocabulary embedding and the mean embedding of their bytes."""
    chars = np.add.reduceat(p["char"][data], np.stack([starts, ends], 1).ravel()[:-1], axis=0)[::2] if len(starts) else np.zeros((0, CHAR), _F)
    return np.concatenate([p["word"][place], chars / (ends - starts)[:, None].astype(_F)], 1)


def _places(vocabulary, hashes):
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, len(vocabulary))


def _index(first_word, size):
    steps = np.arange(WINDOW)
    mask = (steps[None, :] < size[:, None])
    return np.where(mask, first_word[:, None] + steps[None, :], first_word[:, None]), mask.astype(_F)


def text_logits(model: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every text's logit: the highest of its windows; without words, the logit of no evidence."""
    h, starts, ends, first = _words(data, offsets)
    x = _inputs(model, _places(model["vocabulary"], h), data, starts, ends)
    text, at, size = windows(first)
    best = np.full(len(offsets) - 1, -np.inf)
    for k in range(0, len(text), 8192):
        index, mask = _index(at[k:k + 8192], size[k:k + 8192])
        np.maximum.at(best, text[k:k + 8192], _forward(model, x, index, mask))
    best[np.diff(first) == 0] = model["bias"][0]
    return best


def _backward(p, x, index, mask, kept, g):
    """Gradients of the parameters but the embeddings, and of the inputs, for logit gradients ``g``."""
    s, u, e, pooled, fwd, bwd = kept
    d = {"out": pooled.T @ g, "bias": g.sum(keepdims=True)}
    dp = g[:, None] * p["out"]
    ds = e[:, :, None] * dp[None]
    de = (s * dp[None]).sum(2)
    de = e * (de - (e * de).sum(0))
    d["focus"] = np.einsum("tw,twh->h", de, u)
    du = de[:, :, None] * p["focus"] * (1 - u * u)
    d["attend"] = np.einsum("twi,twj->ij", s, du)
    ds = ds + du @ p["attend"].T
    dx = np.zeros_like(x)
    for k, steps, part in (("f", fwd, ds[:, :, :HIDDEN]), ("b", bwd, ds[:, :, HIDDEN:])):
        w, wx = p[f"h{k}"], p[f"x{k}"]
        dw, dwx, dc, dh = np.zeros_like(w), np.zeros_like(wx), np.zeros(3 * HIDDEN, _F), np.zeros((len(g), HIDDEN), _F)
        for t, h, z, r, c in reversed(steps):
            dh = dh + part[t]
            m = mask[:, t:t + 1]
            da_c = dh * m * z * (1 - c * c)
            drh = da_c @ w[:, 2 * HIDDEN:].T
            da = np.concatenate([dh * m * (c - h) * z * (1 - z), drh * h * r * (1 - r), da_c], 1)
            dw[:, :2 * HIDDEN] += h.T @ da[:, :2 * HIDDEN]
            dw[:, 2 * HIDDEN:] += (r * h).T @ da_c
            xt = x[index[:, t]]
            dwx += xt.T @ da
            dc += da.sum(0)
            np.add.at(dx, index[:, t], da @ wx.T)
            dh = dh * (1 - m * z) + drh * r + da[:, :2 * HIDDEN] @ w[:, :2 * HIDDEN].T
        d |= {f"h{k}": dw, f"x{k}": dwx, f"c{k}": dc}
    return d, dx


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS) -> dict[str, np.ndarray]:
    """The network after ``steps`` batches of texts with 0/1 labels, going over them as often as
    that takes; the outcome depends on nothing else."""
    raw = [t.encode() for t in texts]
    docs = [(np.frombuffer(t, np.uint8), *_words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[:3]) for t in raw]
    seen = [np.unique(d[1]) for d in docs]
    vocabulary, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen]), return_counts=True)
    if len(vocabulary) > VOCABULARY:
        least = max(LEAST_SEEN, int(np.partition(count, -VOCABULARY)[-VOCABULARY]))
    else:
        least = LEAST_SEEN
    vocabulary = vocabulary[count >= least]
    toxic, n = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    for words, y in zip(seen, labels, strict=True):
        at = _places(vocabulary, words)
        n[at] += 1
        toxic[at] += y
    base = (labels.sum() + 1) / (len(labels) + 2)
    odds = (toxic[:-1] + 5 * base) / (n[:-1] + 5)
    p = initial(vocabulary, np.log(odds / (1 - odds)) - np.log(base / (1 - base)))
    p["bias"][0] = np.log(base / (1 - base))
    model = p | {"vocabulary": vocabulary}
    if len(set(np.asarray(labels).tolist())) < 2:
        p["out"][:] = 0                                # nothing to tell apart: the prior alone speaks
        return model
    places = [_places(vocabulary, d[1]) for d in docs]
    with_words = [k for k, d in enumerate(docs) if len(d[1])]
    m, v, step, r = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0, np.random.default_rng(2)
    while with_words and step < steps:
        for chosen in np.array_split(r.permutation(with_words), -(-len(with_words) // BATCH))[:steps - step]:
            first = np.concatenate([[0], np.cumsum([len(docs[k][1]) for k in chosen])])
            shift = np.concatenate([[0], np.cumsum([len(docs[k][0]) for k in chosen])])
            data = np.concatenate([docs[k][0] for k in chosen])
            starts = np.concatenate([docs[k][2] + s for k, s in zip(chosen, shift, strict=False)])
            ends = np.concatenate([docs[k][3] + s for k, s in zip(chosen, shift, strict=False)])
            place = np.concatenate([places[k] for k in chosen])
            x = _inputs(p, place, data, starts, ends)
            text, at, size = windows(first)
            logit = np.concatenate([_forward(p, x, *_index(at[q:q + 8192], size[q:q + 8192])) for q in range(0, len(text), 8192)])
            order = np.lexsort((-logit, text))
            top = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]   # each document's highest window
            words = np.unique(np.concatenate([np.arange(at[q], at[q] + size[q]) for q in top]))
            index, mask = _index(np.searchsorted(words, at[top]), size[top])
            xs, kept = x[words], []
            y = labels[chosen].astype(_F)
            g = ((_sigmoid(_forward(p, xs, index, mask, kept)) - y) / len(y)).astype(_F)
            grad, dx = _backward(p, xs, index, mask, kept, g)
            grad["word"] = np.zeros_like(p["word"])
            np.add.at(grad["word"], place[words], dx[:, :WORD])
            bytes_of = np.zeros((len(words), 256), _F)
            for q, w in enumerate(words):
                bytes_of[q] = np.bincount(data[starts[w]:ends[w]], minlength=256) / (ends[w] - starts[w])
            grad["char"] = bytes_of.T @ dx[:, WORD:]
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, a in grad.items():                  # Adam
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(_F)
    return p | {"vocabulary": vocabulary}


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs (doc_id, text)``.

    The network learns from at most ``rows`` labelled documents whose crc32(doc_id) mod 5 is
    not 0. A null text counts as empty; a text without words gets the score of no evidence;
    repeated rows and rows without doc_id are scored like any other (a null doc_id is not
    held out); other columns are not looked at. Without labels every score is 0.5. Nothing
    is shuffled but the sample; the model's size is bounded by its vocabulary limit.
    """
    sample = sorted((r.doc_id, r.text or "", r.label) for r in training_rows(docs, labels, "toxic", 5, 0, rows).collect())
    model = docs.sparkSession.sparkContext.broadcast(train([t for _, t, _ in sample], np.array([y for *_, y in sample], float)))

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch, max_bytes=1 << 20):
                score = 1 / (1 + np.exp(-text_logits(model.value, data, offsets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
