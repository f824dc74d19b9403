"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned with follow-the-regularised-leader (proximal) under elastic-net penalties and the
logits are calibrated with one temperature. Document frequencies cover every training row; weights are
fitted on a bounded sample, ``LanguageParams.sample_per_label`` distinct texts of each label, or all it has.

Edge cases: a null text or one without any letter is ``und`` with score 0; an empty table gives an empty
result; with no usable label every text is ``und``; repeated rows are predicted alike; extra columns pass
through ``annotate`` untouched and never meet the names used here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    """``buckets`` hashed n-grams of ``orders``; FTRL rates and penalties; the bounds of the fitted sample."""

    buckets: int = 1 << 14
    orders: tuple[int, ...] = (1, 2, 3)
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    sample_per_label: int = 1000
    steps: int = 8000


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    params: LanguageParams


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_counts(text: str, params: LanguageParams) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-gram buckets of the lower-cased text and their counts; None without a letter.

    Characters other than letters count as one blank; long texts are counted piece by piece, so that
    memory stays bounded while every n-gram of the whole text is counted.
    """
    if not text:
        return None
    total, step, over, any_letter = None, 1 << 20, max(params.orders) - 1, False
    for at in range(0, len(text), step):
        lead = min(over, at)
        code = np.frombuffer(text[at - lead : at + step].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        any_letter |= bool(letter[lead:].any())
        code = code * letter * np.uint32(0x9E3779B1)
        h, parts = code, []
        for n in range(1, max(params.orders) + 1):
            if len(code) < n:
                break
            h = code if n == 1 else h[:-1] * np.uint32(0x85EBCA6B) + code[n - 1 :] + np.uint32(n)
            if n in params.orders:
                parts.append(h[max(0, lead - n + 1) :] if lead else h)
        h = np.concatenate(parts)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found = np.bincount((h >> np.uint32(32 - (params.buckets - 1).bit_length())).view(np.int32), minlength=params.buckets)
        total = found if total is None else total + found
    if not any_letter:
        return None
    seen = np.flatnonzero(total)
    return seen, total[seen]


def tf_idf(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts
    v = (1 + np.log(n)) * idf[at]
    return at, (v / max(float(np.sqrt(v @ v)), 1e-12)).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_weights(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], labels: list[str], idf: np.ndarray, params: LanguageParams) -> LanguageModel:
    """FTRL-proximal over ``params.steps`` examples, then a temperature from every fifth row, which is not fitted."""
    rng = np.random.default_rng(7)
    rows = [(tf_idf(c, idf), y) for c, y in rows]
    held = [r for i, r in enumerate(rows) if i % 5 == 4] or rows
    fit = [r for i, r in enumerate(rows) if i % 5 != 4] or rows
    k = len(labels)
    z, n = np.zeros((params.buckets, k), np.float32), np.zeros((params.buckets, k), np.float32)
    bias = np.zeros(k)

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * params.l1) / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2)
        return np.where(np.abs(zz) <= params.l1, np.float32(0), w)

    by_label = [[i for i, r in enumerate(fit) if r[1] == y] for y in range(k)]
    present = [y for y in range(k) if by_label[y]]
    for t in range(params.steps):
        (at, v), y = fit[(own := by_label[present[t % len(present)]])[rng.integers(len(own))]]
        w = weights(at)
        g = _softmax(v @ w + bias)
        g[y] -= 1
        grad = v[:, None] * g[None, :].astype(np.float32)
        old = n[at]
        new = old + grad * grad
        z[at] += grad - (np.sqrt(new) - np.sqrt(old)) / params.alpha * w
        n[at] = new
        bias -= 0.02 * g
    w = weights(np.arange(params.buckets)).astype(np.float32)
    logits = np.array([v @ w[at] + bias for (at, v), _ in held])
    y = np.array([r[1] for r in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 80))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return LanguageModel(labels, idf, w, bias, float(grid[int(np.argmin(loss))]), params)


def predict(model: LanguageModel | None, text: str | None) -> tuple[str, float]:
    counts = ngram_counts(text or "", model.params) if model else None
    if counts is None:
        return UNKNOWN, 0.0
    at, v = tf_idf(counts, model.idf)
    p = _softmax((v @ model.weights[at] + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.labels[best], float(p[best])


def fit(training: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel | None:
    """Learn from ``training(text, label)``; None if no row has both a text and a label.

    One pass gathers document frequencies over all rows, two the bounded sample. What reaches the driver are n-gram counts,
    at most ``buckets`` of a text of any length.
    """
    rows = training.select("text", "label").where(F.col("label").isNotNull() & F.col("text").isNotNull())
    labels = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if not labels:
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(params.buckets, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                docs += 1
                if (c := ngram_counts(text.as_py(), params)) is not None:
                    df[c[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], docs), pa.int64())], ["bucket", "df"])

    found = rows.select("text").mapInArrow(frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(params.buckets)
    n = 0
    for r in found:
        if r["bucket"] < 0:
            n = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    idf = np.log((1 + n) / (1 + df)) + 1
    # Each label is bounded by itself: its texts of the lowest hashes, every text once.
    usable = rows.where(F.col("text").rlike(r"\p{L}"))
    usable = usable.withColumn("chance", F.xxhash64("text", "label"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("chance"))
    lowest = usable.select("label", "chance").distinct().withColumn("nth", nth).where(F.col("nth") <= params.sample_per_label)
    bounds = {r["label"]: r["bound"] for r in lowest.groupBy("label").agg(F.max("chance").alias("bound")).collect()}
    if not bounds:
        return None
    bound = F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv])
    sample = usable.where(F.col("chance") <= F.element_at(bound, F.col("label"))).dropDuplicates(["label", "chance"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(t.as_py(), params) for t in batch.column(2)]
            columns = [pa.array([None if c is None else c[k].astype("<i8").tobytes() for c in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["label", "chance", "at", "n"])

    kind = sample.schema["label"].dataType.simpleString()
    told = sample.select("label", "chance", "text").mapInArrow(counts, f"label {kind}, chance long, at binary, n binary")
    rows_ = told.where(F.col("at").isNotNull()).orderBy("chance", "label").collect()
    number = {k: i for i, k in enumerate(labels)}
    data = [((np.frombuffer(r["at"], "<i8"), np.frombuffer(r["n"], "<i8")), number[r["label"]]) for r in rows_]
    return fit_weights(data, labels, idf, params) if data else None


def annotate(docs: DataFrame, model: LanguageModel | None, out: tuple[str, str] = ("lang_pred", "score"), threshold: float | None = None) -> DataFrame:
    """All columns of ``docs`` and the two named; with ``threshold``, only rows of a known language that reach it.

    One narrow pass: no shuffle, whole texts, memory bounded by an Arrow batch.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            found = [predict(m, t.as_py()) for t in batch.column(at)]
            lang, score = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            if threshold is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, lang, score], [*batch.schema.names, *out])
            else:
                yield batch.filter(pa.array([f[0] != UNKNOWN and f[1] >= threshold for f in found], pa.bool_()))

    schema = docs.schema
    if threshold is None:
        schema = T.StructType([*docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def training_rows(documents: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id, as text, leaves a remainder other than 2 by 4; labels are their ``lang``."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    return documents.where(fold != 2).select("text", F.col("lang").alias("label"))


def identify(documents: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; a null id is not held out and teaches nothing."""
    model = fit(training_rows(documents), params)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return annotate(documents.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
