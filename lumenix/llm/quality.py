"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Every passage (a run of ``passage_words`` words; the last one may be shorter) is encoded, gated attention
weights are learned from document labels only, and the attention-weighted passage representation is scored.
The whole text is read; memory grows with one block of rows, or with one text if that is longer.

Edge cases: null and empty texts form one empty passage and get a score; without labels of both kinds every
score is the share of label 1 (0.5 if there is none); repeated rows are scored alike; a score of exactly the threshold is
predicted as 1; an empty table gives an empty result; extra columns pass through ``annotate`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenix.llm import common


@dataclass(frozen=True)
class QualityParams:
    """Passage length, widths, training steps (the same for any input) and bounds of the fitted sample."""

    passage_words: int = 64
    hidden: int = 24
    attention: int = 12
    steps: int = 700
    batch: int = 48
    rate: float = 0.01
    decay: float = 1e-4
    sample_per_label: int = 1500
    fit_words: int = 6400
    threshold: float = 0.7


# 24 classes of bytes: their bigrams describe the shape of a passage in any script.
_CLASS = np.full(256, 23, np.int64)
_CLASS[32], _CLASS[9], _CLASS[10], _CLASS[13] = 0, 0, 1, 1
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 3, 4
_CLASS[[97, 101, 105, 111, 117]] = 5
for _i, _group in enumerate([".", ",", "!?", ";:", "'\"`", "-_", "()[]{}", "<>", "/\\", "|", "@", "#", "$", "%", "&", "*+=^~"]):
    for _c in _group:
        _CLASS[ord(_c)] = 6 + _i
_CLASS[128:192], _CLASS[192:] = 22, 22
_K = 24
EXTRA = 6


def passage_features(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages and, per row of text, the first passage's number (n + 1 values)."""
    s, e, first = common.word_bounds(raw, offsets)
    n_words = np.diff(first)
    count = np.maximum(1, -(-n_words // words))
    start = np.concatenate([[0], np.cumsum(count)])
    total = int(start[-1])
    out = np.zeros((total, _K * _K + EXTRA), np.float32)
    if len(s):
        row = np.repeat(np.arange(len(n_words)), n_words)
        inside = np.arange(len(s)) - first[row]
        of_word = start[row] + inside // words
        # Each byte belongs to the passage of the latest word start in its row.
        mark = np.zeros(len(raw), np.int64)
        heads = np.flatnonzero(np.diff(of_word, prepend=-1))
        at = s[heads].copy()
        lead = np.flatnonzero(np.diff(row[heads], prepend=-1))
        at[lead] = offsets[row[heads][lead]]
        mark[at] = np.diff(of_word[heads], prepend=0)
        of_byte = np.cumsum(mark)
        cls = _CLASS[raw]
        same = of_byte[1:] == of_byte[:-1]
        key = (of_byte[:-1] * _K + cls[:-1]) * _K + cls[1:]
        grams = np.bincount(key[same], minlength=total * _K * _K).reshape(total, -1).astype(np.float32)
        size = np.maximum(grams.sum(1, keepdims=True), 1)
        out[:, : _K * _K] = np.sqrt(grams / size)
        h = common.hash_spans(raw, s, e, True)
        filled = np.bincount(of_word, minlength=total)
        n = np.maximum(filled, 1)
        for k, lag in enumerate((1, 2, 3)):
            if len(h) > lag:
                eq = (h[lag:] == h[:-lag]) & (of_word[lag:] == of_word[:-lag])
                out[:, -1 - k] = np.bincount(of_word[lag:], eq, total) / n
        out[:, -4] = np.bincount(of_word, (e - s), total) / n / 10
        out[:, -5] = np.log1p(filled) / 5
        order = np.lexsort((h, of_word))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
        out[:, -6] = np.bincount(of_word[order], fresh, total) / n
    return out, start


def init(width: int, params: QualityParams) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    g = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
    h, a = params.hidden, params.attention
    return {"W": g(width, h), "b": np.zeros(h, np.float32), "V": g(h, a), "U": g(h, a), "q": g(a, 1)[:, 0], "c": g(h, 1)[:, 0], "d": np.zeros(1, np.float32)}


def forward(m: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray) -> tuple:
    """Document logits and what the gradient needs; ``start`` bounds each document's passages."""
    h = np.tanh(x @ m["W"] + m["b"])
    t, u = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * u) @ m["q"]
    n, lo = np.diff(start), start[:-1]
    w = np.exp(e - np.repeat(np.maximum.reduceat(e, lo), n))
    w /= np.repeat(np.add.reduceat(w, lo), n)
    z = np.add.reduceat(w[:, None] * h, lo, axis=0)
    return z @ m["c"] + m["d"][0], h, t, u, w, z


def gradients(m: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    logit, h, t, u, w, z = forward(m, x, start)
    n, lo = np.diff(start), start[:-1]
    g = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
    dz = np.repeat(g[:, None] * m["c"], n, axis=0)
    dw = (dz * h).sum(1)
    de = w * (dw - np.repeat(np.add.reduceat(w * dw, lo), n))
    dtu = de[:, None] * m["q"]
    dt, du = dtu * u * (1 - t * t), dtu * t * u * (1 - u)
    dh = (w[:, None] * dz + dt @ m["V"].T + du @ m["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ du, "q": (t * u).T @ de, "c": z.T @ g, "d": np.array([g.sum()], np.float32)}


def adam(m: dict[str, np.ndarray], g: dict[str, np.ndarray], state: dict, t: int, rate: float, decay: float) -> None:
    for k, v in g.items():
        a, b = state.setdefault(k, (np.zeros_like(m[k]), np.zeros_like(m[k])))
        a += 0.1 * (v - a)
        b += 0.001 * (v * v - b)
        m[k] -= (rate * (a / (1 - 0.9**t) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8) + decay * m[k])).astype(m[k].dtype)


def fit(sample: list[tuple[str, int]], params: QualityParams) -> dict[str, np.ndarray] | float:
    """A model from (text, label) rows; with one kind of label or none, that share as a constant."""
    y = np.array([r[1] for r in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    bags = []
    for text, _ in sample:
        raw, off = common.text_bytes(pa.array([text], pa.string()))
        bags.append(passage_features(raw, off, params.passage_words)[0])
    m, state, rng = init(bags[0].shape[1], params), {}, np.random.default_rng(5)
    kinds = [np.flatnonzero(y == k) for k in (0, 1)]
    share = float(y.mean())
    for t in range(1, params.steps + 1):
        pick = np.concatenate([rng.choice(k, params.batch // 2) for k in kinds])
        start = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
        weight = np.where(y[pick] == 1, 1.0, 1.0).astype(np.float32)
        adam(m, gradients(m, np.concatenate([bags[i] for i in pick]), start, y[pick], weight), state, t, params.rate * min(1.0, 2 * (1 - t / (params.steps + 1))), params.decay)
    # Training draws both kinds equally often; the shift restores the sample's own share.
    m["d"] = m["d"] + np.float32(0.5 * np.log(share / (1 - share)))
    return m


def scores(m: dict[str, np.ndarray] | float, column: pa.Array, params: QualityParams) -> np.ndarray:
    raw, off = common.text_bytes(column)
    out = np.zeros(len(column))
    for i, j in common.blocks(off, 1 << 19):
        if isinstance(m, float):
            out[i:j] = m
            continue
        x, start = passage_features(raw[off[i] : off[j]], off[i : j + 1] - off[i], params.passage_words)
        out[i:j] = 1 / (1 + np.exp(-forward(m, x, start)[0].astype(float)))
    return out


def learn(documents: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> dict[str, np.ndarray] | float:
    """Fit on ``sample_per_label`` documents of each label whose id's crc32 mod 4 is not 2, or all it has; of longer texts
    on ``fit_words`` words spread over the whole of them."""
    known = labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label"))
    return fit(common.labelled_sample(documents, known, params.sample_per_label, params.fit_words, params.passage_words), params)


def annotate(docs: DataFrame, model: dict[str, np.ndarray] | float, params: QualityParams = QualityParams(), out: str = "score", threshold: float | None = None) -> DataFrame:
    """All columns of ``docs`` and ``out``; with ``threshold``, only the rows that reach it and no new column."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(held.value, batch.column(at), params)
            if threshold is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, out])
            else:
                yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema if threshold is not None else T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = learn(documents, labels, params)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = annotate(documents.select("doc_id", "text"), model, params)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))
