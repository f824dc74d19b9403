"""Vector functions: products, norms and means in the JVM; embedders as Arrow UDFs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), product)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def unit(a: Column) -> Column:
    """L2-normalized; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v.cast("double") / n)).otherwise(F.transform(a, lambda v: v.cast("double")))


def mean_components(a: Column, width: int) -> list[Column]:
    """Aggregates for the components of a mean vector, one pass with map-side combine."""
    return [F.avg(F.get(a, F.lit(i)).cast("double")).alias(f"c{i}") for i in range(width)]


def normalized_mean(grouped, a: Column, width: int, name: str = "centroid"):  # type: ignore[no-untyped-def]
    """Group means as unit vectors: ``df.groupBy(...)`` in, one row per group out."""
    df = grouped.agg(*mean_components(a, width))
    return df.withColumn(name, unit(F.array(*[F.col(f"c{i}") for i in range(width)]))).drop(*[f"c{i}" for i in range(width)])


# -- embedders

_RUN = re.compile(r"\w+")


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def hash_vector(words: Sequence[str], width: int = 256) -> np.ndarray:
    """Signed feature hashing of terms onto the unit sphere: an embedder without weights, for tests and offline use."""
    v = np.zeros(width, np.float32)
    for w in words:
        h = fnv1a(w.encode())
        v[h % width] += -1.0 if h >> 63 else 1.0
    n = float(np.linalg.norm(v))
    return v / n if n > 0 else v


def hash_embedder(width: int = 256) -> Callable[[Column], Column]:
    """Embeds an array of terms."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: hash_vector([] if t is None else list(t), width).tolist())

    return embed


def static_vector(ids: Sequence[int], table: np.ndarray, normalize: bool = True) -> np.ndarray:
    """Mean of the table's rows for the ids in range; zeros if there is none."""
    ok = [i for i in ids if 0 <= i < len(table)]
    v = table[ok].mean(0) if ok else np.zeros(table.shape[1], np.float32)
    n = float(np.linalg.norm(v))
    return (v / n if normalize and n > 0 else v).astype(np.float32)


def static_embedder(spark, table: np.ndarray, normalize: bool = True) -> Callable[[Column], Column]:  # type: ignore[no-untyped-def]
    """Embeds an array of token ids with a broadcast table (a model's fixed size, not the corpus's)."""
    held = spark.sparkContext.broadcast(table.astype(np.float32))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(ids: pd.Series) -> pd.Series:
        return ids.map(lambda t: static_vector([] if t is None else list(t), held.value, normalize).tolist())

    return embed


def tokenizing_embedder(spark, tokenizer_file: str, table: np.ndarray, normalize: bool = True) -> Callable[[Column], Column]:  # type: ignore[no-untyped-def]
    """Embeds raw text: a tokenizer file (no special tokens) in front of a static table. Weights are the caller's."""
    held = spark.sparkContext.broadcast(table.astype(np.float32))
    loaded: dict = {}

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        if "t" not in loaded:
            from tokenizers import Tokenizer

            loaded["t"] = Tokenizer.from_file(tokenizer_file)
        found = loaded["t"].encode_batch_fast(["" if x is None else x for x in text], add_special_tokens=False)
        return pd.Series([static_vector(e.ids, held.value, normalize).tolist() for e in found])

    return embed


TENSOR = "dtype string, shape array<int>, data binary"
DTYPES = {"f32": "<f4", "f16": "<f2", "i8": "<i1"}


def encode_tensors(df, source: str, name: str, dtype: str = "f32"):  # type: ignore[no-untyped-def]
    """``df`` and a column ``name`` with each vector as little-endian bytes beside its type and shape."""
    import pyarrow as pa

    if dtype not in DTYPES:
        raise ValueError(f"unknown dtype {dtype!r}")
    at = df.columns.index(source)
    kind = pa.struct([("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.binary())])

    def run(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            rows = [None if v.as_py() is None else {"dtype": dtype, "shape": [len(v)], "data": np.asarray(v.as_py(), DTYPES[dtype]).tobytes()} for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(TENSOR))]))


def decode_tensors(df, source: str, name: str, width: int | None = None):  # type: ignore[no-untyped-def]
    """``df`` and a column ``name`` with the vectors that ``encode_tensors`` wrote; null where type, shape, bytes or the asked
    ``width`` do not fit."""
    import pyarrow as pa

    at = df.columns.index(source)

    def one(t: dict | None) -> np.ndarray | None:
        if t is None or t["dtype"] not in DTYPES or len(t["shape"] or ()) != 1 or (width is not None and t["shape"][0] != width):
            return None
        size = np.dtype(DTYPES[t["dtype"]]).itemsize
        return np.frombuffer(t["data"], DTYPES[t["dtype"]]).astype(np.float32) if t["data"] is not None and len(t["data"]) == size * t["shape"][0] else None

    def run(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            rows = [one(v.as_py()) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))


def embed_rows(df, source: str, name: str, embed: Callable[[Sequence], np.ndarray]):  # type: ignore[no-untyped-def]
    """``df`` and an array column ``name`` = embed(source), in Arrow batches: a stage of its own, so that nothing
    above it makes the optimizer embed twice."""
    import pyarrow as pa

    at = df.columns.index(source)

    def run(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            rows = [np.asarray(embed(v.as_py() or []), np.float32) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))


def hashed_rows(df, source: str, name: str, width: int = 256):  # type: ignore[no-untyped-def]
    """``embed_rows`` by ``hash_vector``: a word is hashed once a task, or once for every million different ones, and the vectors
    of many rows are added up together."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = df.columns.index(source)

    def run(batches):  # type: ignore[no-untyped-def]
        known: dict[str, int] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                terms = batch.column(at)
                coded = pc.dictionary_encode(terms.flatten())
                words = coded.dictionary.to_pylist()
                if len(known) > 1_000_000:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = fnv1a(w.encode())
                h = np.fromiter((known[w] for w in words), np.uint64, len(words))
                code = coded.indices.to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(terms)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
                sign, slot = np.where(h >> np.uint64(63), -1.0, 1.0), (h % np.uint64(width)).astype(np.int64)
                v = np.bincount(row * width + slot[code], sign[code], len(terms) * width).reshape(-1, width)
                n = np.sqrt((v * v).sum(1).astype(np.float32))[:, None]
                v = v.astype(np.float32) / np.where(n > 0, n, np.float32(1))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1) * width, pa.int32()), pa.array(v.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))


def verified_weights(data: bytes, size: int, sha256: str) -> bytes:
    """Model bytes only if their length and digest are the pinned ones."""
    if len(data) != size or hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the weights differ from what is pinned")
    return data
