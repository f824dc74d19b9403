"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word, without case and punctuation around it, enters as its hashed embedding beside the pooled embeddings
of its character trigrams (with word edges), so that unseen inflections of known terms are recognised. The
network, trained in numpy with back-propagation through time, scores every overlapping window of a text; a document has its worst
window's score. Windows are ``window`` words long and start every ``stride`` words over the whole text.

Edge cases: null and empty texts have no window and get the score of an empty one (the bias alone);
without labels of both kinds every score is the share of label 1 (0 if there is none); repeated rows
are scored alike; a score of exactly 0.5 is predicted as 1; very long texts are scored block by block; an empty table gives an
empty result; only ``doc_id``, ``text`` and the named columns of ``labels`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenix.llm import common
from lumenix.llm.quality import adam


@dataclass(frozen=True)
class ToxicityParams:
    """Window geometry, widths, training steps (the same for any input) and bounds of the fitted sample."""

    window: int = 40
    stride: int = 24
    word_buckets: int = 1 << 13
    char_buckets: int = 1 << 13
    word_width: int = 10
    char_width: int = 14
    hidden: int = 8
    attention: int = 8
    steps: int = 600
    batch: int = 64
    rate: float = 0.01
    sample_per_label: int = 1200
    fit_words: int = 4000


_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True


@dataclass
class Words:
    """Distinct words of a block: their hash bucket and the trigram buckets of each, back to back."""

    bucket: np.ndarray
    grams: np.ndarray
    start: np.ndarray


def bare(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without the punctuation around them; a word of nothing else stays as it is."""
    at = np.flatnonzero(_SOLID[raw])
    if not len(at):
        return s, e
    a, b = np.searchsorted(at, s), np.searchsorted(at, e)
    some = b > a
    return np.where(some, at[np.minimum(a, len(at) - 1)], s), np.where(some, at[np.maximum(b - 1, 0)] + 1, e)


def distinct_words(raw: np.ndarray, s: np.ndarray, e: np.ndarray, p: ToxicityParams) -> tuple[Words, np.ndarray]:
    """The distinct words (A-Z folded, without punctuation around them) and each occurrence's number among them."""
    s, e = bare(raw, s, e)
    h = common.hash_spans(raw, s, e, True)
    u, at, number = np.unique(h, return_index=True, return_inverse=True)
    lo, n = s[at], (e - s)[at]
    start = np.concatenate([[0], np.cumsum(n)])
    pos = np.arange(start[-1]) - np.repeat(start[:-1], n)
    byte = np.repeat(lo, n) + pos
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint32)
    mid = low[byte]
    left = np.where(pos == 0, np.uint32(1), low[np.maximum(byte - 1, 0)])
    right = np.where(pos == np.repeat(n, n) - 1, np.uint32(2), low[np.minimum(byte + 1, max(len(raw) - 1, 0))])
    g = (left * np.uint32(0x9E3779B1) + mid) * np.uint32(0x85EBCA6B) + right * np.uint32(0xC2B2AE35)
    g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return Words((u % np.uint64(p.word_buckets)).astype(np.int64), (g >> np.uint32(32 - (p.char_buckets - 1).bit_length())).astype(np.int64), start), number


def windows(first: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (as a word number) and length of every window, and its row; a row without words has none."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - p.window) // p.stride)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = first[row] + k * p.stride
    return start, np.minimum(p.window, first[row + 1] - start), row


def init(p: ToxicityParams) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(3)
    g = lambda a, b, k=1.0: (rng.normal(size=(a, b)) * k / np.sqrt(a)).astype(np.float32)
    d, h, a = p.word_width + p.char_width, p.hidden, p.attention
    m = {"Ew": (rng.normal(size=(p.word_buckets, p.word_width)) * 0.1).astype(np.float32), "Ec": (rng.normal(size=(p.char_buckets, p.char_width)) * 0.3).astype(np.float32)}
    for k in "fb":
        m |= {f"W{k}": g(d, 3 * h), f"U{k}": g(h, 3 * h), f"B{k}": np.zeros(3 * h, np.float32)}
        m[f"B{k}"][:h] = 0.5
    return m | {"Wa": g(2 * h, a), "ba": np.zeros(a, np.float32), "va": g(a, 1)[:, 0], "o": g(2 * h, 1)[:, 0], "c": np.zeros(1, np.float32)}


def embed(m: dict[str, np.ndarray], w: Words) -> np.ndarray:
    n = np.diff(w.start)
    chars = np.add.reduceat(m["Ec"][w.grams], w.start[:-1], axis=0) / np.sqrt(n)[:, None].astype(np.float32) if len(n) else np.zeros((0, m["Ec"].shape[1]), np.float32)
    return np.concatenate([m["Ew"][w.bucket], chars], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def run_direction(m: dict[str, np.ndarray], k: str, x: np.ndarray, idx: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (step, window, hidden). Windows are sorted by falling length; ``live[t]`` of them reach step t."""
    steps, n = idx.shape
    h_size = m[f"U{k}"].shape[0]
    proj = x @ m[f"W{k}"] + m[f"B{k}"]
    u = m[f"U{k}"]
    states = np.zeros((steps, n, h_size), np.float32)
    h = np.zeros((n, h_size), np.float32)
    for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
        c = live[t]
        old = h[:c]
        a, b = proj[idx[t, :c]], old @ u
        zr = _sigmoid(a[:, : 2 * h_size] + b[:, : 2 * h_size])
        z, r = zr[:, :h_size], zr[:, h_size:]
        bn = b[:, 2 * h_size :]
        new = np.tanh(a[:, 2 * h_size :] + r * bn)
        out = new + z * (old - new)
        if keep is not None:
            keep.append((t, c, old.copy(), z, r, bn, new))
        h[:c] = out
        states[t, :c] = out
    return states


def layout(start: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by falling length, word numbers (step, window) in it, and how many windows reach each step."""
    order = np.argsort(-length, kind="stable")
    steps = int(length.max())
    live = np.searchsorted(-length[order], -np.arange(steps), "left")
    at = np.minimum(start[order][None, :] + np.arange(steps)[:, None], len(number) - 1)
    return order, number[at], live


def forward(m: dict[str, np.ndarray], x: np.ndarray, idx: np.ndarray, live: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows in the order of ``layout``."""
    kf, kb = ([], []) if keep is not None else (None, None)
    h = np.concatenate([run_direction(m, "f", x, idx, live, kf), run_direction(m, "b", x, idx, live, kb)], axis=2)
    t = np.tanh(h @ m["Wa"] + m["ba"])
    e = t @ m["va"]
    e = np.where(np.arange(len(idx))[:, None] < length[None, :], e, -np.inf)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = (w[:, :, None] * h).sum(0)
    if keep is not None:
        keep |= {"f": kf, "b": kb, "h": h, "t": t, "w": w, "pooled": pooled}
    return pooled @ m["o"] + m["c"][0]


def gradients(m: dict[str, np.ndarray], words: Words, idx: np.ndarray, live: np.ndarray, length: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Mean logistic loss over windows, differentiated through attention and both directions in time."""
    x, k = embed(m, words), {}
    logit = forward(m, x, idx, live, length, k)
    g = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    out = {"o": k["pooled"].T @ g, "c": np.array([g.sum()], np.float32)}
    dp = g[:, None] * m["o"]
    dw = (k["h"] * dp).sum(2)
    de = k["w"] * (dw - (k["w"] * dw).sum(0))
    dt = de[:, :, None] * m["va"] * (1 - k["t"] ** 2)
    out["va"] = (k["t"] * de[:, :, None]).sum((0, 1))
    flat = dt.reshape(-1, dt.shape[2])
    out["Wa"], out["ba"] = k["h"].reshape(len(flat), -1).T @ flat, flat.sum(0)
    dh = k["w"][:, :, None] * dp + dt @ m["Wa"].T
    hs = m["Uf"].shape[0]
    dx = np.zeros_like(x)
    for d, cols in (("f", slice(0, hs)), ("b", slice(hs, 2 * hs))):
        u = m[f"U{d}"]
        dproj = np.zeros((len(x), 3 * hs), np.float32)
        du = np.zeros_like(u)
        carry = np.zeros((idx.shape[1], hs), np.float32)
        for t, c, old, z, r, bn, new in reversed(k[d]):
            gh = dh[t, :c, cols] + carry[:c]
            dn = gh * (1 - z) * (1 - new * new)
            a = np.concatenate([gh * (old - new) * z * (1 - z), dn * bn * r * (1 - r), dn], axis=1)
            b = a.copy()
            b[:, 2 * hs :] *= r
            du += old.T @ b
            carry[:c] = gh * z + b @ u.T
            np.add.at(dproj, idx[t, :c], a)
        out[f"U{d}"], out[f"W{d}"], out[f"B{d}"] = du, x.T @ dproj, dproj.sum(0)
        dx += dproj @ m[f"W{d}"].T
    n = np.diff(words.start)
    out["Ew"], out["Ec"] = np.zeros_like(m["Ew"]), np.zeros_like(m["Ec"])
    ww = m["Ew"].shape[1]
    np.add.at(out["Ew"], words.bucket, dx[:, :ww])
    np.add.at(out["Ec"], words.grams, np.repeat(dx[:, ww:] / np.sqrt(n)[:, None].astype(np.float32), n, axis=0))
    return out


def subset(words: Words, at: np.ndarray) -> Words:
    n = np.diff(words.start)[at]
    start = np.concatenate([[0], np.cumsum(n)])
    return Words(words.bucket[at], words.grams[np.arange(start[-1]) - np.repeat(start[:-1], n) + np.repeat(words.start[:-1][at], n)], start)


def fit(sample: list[tuple[str, int]], p: ToxicityParams = ToxicityParams()) -> dict[str, np.ndarray] | float:
    """Multiple-instance training: of each drawn document, its worst window as scored so far is fitted to the label
    (early on, any window at times), both labels drawn equally often; then one scale and shift of the document logits."""
    sample = [r for r in sample if r[0] and r[0].strip()]
    y = np.array([r[1] for r in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    raw, off = common.text_bytes(pa.array([r[0] for r in sample], pa.string()))
    s, e, first = common.word_bounds(raw, off)
    words, number = distinct_words(raw, s, e, p)
    start, length, row = windows(first, p)
    of_row = [np.flatnonzero(row == i) for i in range(len(sample))] if len(sample) < 64 else np.split(np.arange(len(row)), np.searchsorted(row, np.arange(1, len(sample))))
    usable = np.array([len(w) > 0 for w in of_row])
    rng, m, state = np.random.default_rng(9), init(p), {}
    tune = np.arange(len(y)) % 5 == 4
    kinds = [np.flatnonzero((y == k) & usable & ~tune) for k in (0, 1)]
    if not all(map(len, kinds)):
        kinds, tune = [np.flatnonzero((y == k) & usable) for k in (0, 1)], usable

    def worst(rows: np.ndarray, random_share: float) -> tuple[np.ndarray, np.ndarray]:
        win = np.concatenate([of_row[i] for i in rows])
        order, idx, live = layout(start[win], length[win], number)
        used, local = np.unique(idx, return_inverse=True)
        logit = np.empty(len(win))
        logit[order] = forward(m, embed(m, subset(words, used)), local.reshape(idx.shape), live, length[win][order])
        at = np.concatenate([[0], np.cumsum([len(of_row[i]) for i in rows])])
        pick = [lo + (rng.integers(hi - lo) if rng.random() < random_share else int(logit[lo:hi].argmax())) for lo, hi in zip(at, at[1:])]
        return win[pick], logit[pick]

    for t in range(1, p.steps + 1):
        rows = np.concatenate([rng.choice(k, p.batch // 2) for k in kinds])
        win, _ = worst(rows, 0.5 * max(0.0, 1 - 3 * t / p.steps))
        order, idx, live = layout(start[win], length[win], number)
        used, local = np.unique(idx, return_inverse=True)
        g = gradients(m, subset(words, used), local.reshape(idx.shape), live, length[win][order], y[rows][order])
        adam(m, g, state, t, p.rate * min(1.0, 2 * (1 - t / (p.steps + 1))), 1e-4)
    rows = np.flatnonzero(tune & usable)
    z = np.concatenate([worst(rows[i : i + 64], 0)[1] for i in range(0, len(rows), 64)])
    a, b = 1.0, 0.0
    for _ in range(300):
        q = _sigmoid(a * z + b) - y[rows]
        a, b = max(0.05, a - 0.1 * float((q * z).mean()) / max(1.0, float((z * z).mean()) / 4)), b - 0.3 * float(q.mean())
    m["o"], m["c"] = (m["o"] * a).astype(np.float32), (m["c"] * a + b).astype(np.float32)
    return m


def scores(m: dict[str, np.ndarray] | float, column: pa.Array, p: ToxicityParams) -> np.ndarray:
    raw, off = common.text_bytes(column)
    out = np.full(len(column), m if isinstance(m, float) else _sigmoid(float(m["c"][0])))
    if isinstance(m, float):
        return out
    for i, j in common.blocks(off, 1 << 19):
        part = raw[off[i] : off[j]]
        s, e, first = common.word_bounds(part, off[i : j + 1] - off[i])
        if not len(s):
            continue
        words, number = distinct_words(part, s, e, p)
        x = embed(m, words)
        start, length, row = windows(first, p)
        best = np.full(j - i, -np.inf)
        for w in range(0, len(row), 8192):  # one very long text has many windows
            cut = slice(w, w + 8192)
            order, idx, live = layout(start[cut], length[cut], number)
            np.maximum.at(best, row[cut][order], forward(m, x, idx, live, length[cut][order]))
        seen = best > -np.inf
        out[i:j][seen] = _sigmoid(best[seen])
    return out


def learn(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> dict[str, np.ndarray] | float:
    """Fit on ``sample_per_label`` documents of each label whose id's crc32 mod 5 is not 0, or all it has; of longer texts
    on ``fit_words`` words spread over the whole of them."""
    known = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return fit(common.labelled_sample(documents, known, params.sample_per_label, params.fit_words, params.window), params)


def classify(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document: one narrow pass over whole texts."""
    model = learn(documents, labels, params)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(held.value, batch.column(1), params))], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
