"""Shared plumbing: table access, durable intermediate tables, Arrow batches, hashing of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenix.sources.scratch import discard, fresh_path, materialize, shared_dir  # noqa: F401
from lumenix.sources.tables import ensure_importable, table  # noqa: F401


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(kept: DataFrame, documents: DataFrame, same: Column) -> DataFrame:
    """``kept``, some rows of ``documents``, with one of the rows that have an id and ``same`` in common: the one with the
    longest text. Only rows whose id occurs more than once in ``documents`` are moved."""
    name = unused_name(kept, "repeated_id")
    again = documents.groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name)
    if again.isEmpty():
        return kept
    on = F.col("doc_id").eqNullSafe(F.col(name))
    longest = F.max_by(F.struct(*[kept[c] for c in kept.columns]), F.struct(F.coalesce(F.length("text"), F.lit(0)), F.xxhash64("text")))
    picked = kept.join(again, on, "left_semi").groupBy(F.col("doc_id"), F.sha2(same.cast("binary"), 256)).agg(longest.alias("picked"))
    return kept.join(again, on, "left_anti").unionByName(picked.select("picked.*"))


def labelled_sample(documents: DataFrame, known: DataFrame, most: int, fit_words: int, stretch: int) -> list[tuple[str, int]]:
    """(text, label) of the ``most`` documents of each label in ``known(doc_id, label)`` with the lowest hashes, or all it has.

    Of a text of more than ``fit_words`` words, stretches of ``stretch`` words spread evenly over the whole of it are taken,
    ``fit_words`` in all; so the sample that reaches the driver is bounded, and no text is left out for its length.
    """
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.withColumn("nth", nth).where(F.col("nth") <= most).select(F.col("doc_id").alias("chosen_id"), "label")
    met = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    one = met.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # an id may have several rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spread(t.as_py(), fit_words, stretch) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "label", "text"])

    kind, label = (one.schema[c].dataType.simpleString() for c in ("doc_id", "label"))
    rows = one.mapInArrow(run, f"doc_id {kind}, label {label}, text string").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [(r["text"], int(r["label"])) for r in rows]


def spread(text: str, most: int, stretch: int) -> str:
    """``text``, or ``most`` words of it in evenly spread stretches if it has more."""
    raw, off = text_bytes(pa.array([text], pa.string()))
    s, e, _ = word_bounds(raw, off)
    if len(s) <= most:
        return text
    starts = np.linspace(0, len(s) - stretch, max(1, most // stretch)).astype(np.int64)
    return " ".join(raw[s[i] : e[i + stretch - 1]].tobytes().decode("utf-8", "ignore") for i in starts)


# -- Arrow text


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its ``n + 1`` offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``budget`` bytes; a longer row forms a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1)
        yield i, j
        i = j


# -- word hashing

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[k] = np.cumprod(steps)
    return _POW[0], _POW[1]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per row, the number of words before it (n + 1 values)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = SPACE[raw]
    begins = ~space
    ends = begins.copy()
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before, after = space[:-1].copy(), space[1:].copy()
    before[edges - 1] = True
    after[edges - 1] = True
    begins[1:] &= before
    ends[:-1] &= after
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def hash_spans(raw: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of byte spans; ``fold`` lower-cases A-Z."""
    if not len(s):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
