"""Exact top-k inner-product search on a bit-sliced index.

The index is written once: rows are spread over segments of about ``segment_rows``, sorted by id there, and a segment keeps,
for every attribute (a component turned into floor(scale * x)), one bitmap per bit of its two's complement, and the ids. For
a query, the slices of each attribute, shifted by the signed digits of the query's component, are added with bitmap
arithmetic (carry-save adders, then one ripple) into the slices of the score. The top rows are taken from the most
significant slice downward; rows of equal score at the boundary are resolved exactly, by smaller id, and a winner's score is
read off its slices. Segments' winners are merged per query.

Queries go in blocks of ``query_block`` against all segments. A unit is one segment's bitmaps (about 90 bytes a row) and one
block, joined on both numbers, so that no task meets more than its units and neither side is collected. Each row is shuffled
once for each block, as bitmaps: work and shuffle are those of the stated queries times rows, in blocks.

Edge cases: a null vector or one with null or non-finite components takes no part; components may be of any size, and
a winner's score beyond 64 bits is an error, never a wrong number; vectors of another length than the query's are no
candidates; rows that share the query's id are its own; a query id that occurs with several vectors is answered once, with
ranks of its own, for each distinct vector; a candidate id that occurs in several rows is a candidate for each; fewer
candidates than k give them all; an empty table gives an empty result; only ``vec_id`` and ``embedding`` are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenix.llm import common


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    scale: int = 1024
    segment_rows: int = 16384
    query_block: int = 512


WHOLE = float(1 << 52)  # doubles from here on have no fraction


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as double, which holds it at any size; null if the vector takes no part."""
    y = lambda x: F.lit(float(scale)) * x.cast("double")
    q = F.transform(vector, lambda x: F.when(F.abs(y(x)) < WHOLE, F.floor(y(x)).cast("double")).otherwise(y(x)))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & fine, q)


def integers(rows: list | np.ndarray) -> np.ndarray:
    """Whole numbers given as doubles, in int64 where all fit, else as Python's."""
    a = np.array(rows, np.float64)
    return a.astype(np.int64) if not a.size or np.abs(a).max() < 2.0**62 else np.vectorize(int, otypes=[object])(a)


def bitmaps(values: np.ndarray) -> np.ndarray:
    """(bits, words) slices of the two's complement of ``values``, rows in the low bits first."""
    n = len(values)
    bits = int(max(values.max(initial=0), -(values.min(initial=0) + 1))).bit_length() + 1
    out = np.zeros((bits, -(-n // 64)), np.uint64)
    padded = np.zeros(out.shape[1] * 64, values.dtype)
    padded[:n] = values
    for b in range(bits):
        out[b] = np.packbits((padded >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(sign, shift) pairs, no two adjacent shifts, that add up to ``value``."""
    out, shift = [], 0
    while value:
        if value & 1:
            d = 2 - (value & 3)
            out.append((d, shift))
            value -= d
        value >>= 1
        shift += 1
    return out


def score_slices(slices: list[np.ndarray], query: np.ndarray) -> np.ndarray:
    """Slices (two's complement) of the inner products of all rows with ``query``.

    A negative digit adds the complement and one; sign extension is folded into one constant, so that every
    partial product is a plain slice at its weight.
    """
    words = slices[0].shape[1]
    width = 2 + sum(int(abs(int(q))) * (1 << (len(s) - 1)) for s, q in zip(slices, query)).bit_length()
    columns: list[list[np.ndarray]] = [[] for _ in range(width)]
    constant = 0
    for s, q in zip(slices, query):
        for sign, shift in signed_digits(int(q)):
            top = len(s) - 1
            if sign > 0:  # -top*2^top + low  =  low + not(top)*2^top - 2^top
                for b in range(top):
                    columns[b + shift].append(s[b])
                columns[top + shift].append(~s[top])
            else:  # -(x) = not(x) + 1, whose top bit enters with its own sign
                for b in range(top):
                    columns[b + shift].append(~s[b])
                columns[top + shift].append(s[top])
                constant += 1 << shift
            constant -= 1 << (top + shift)
    full = np.full(words, np.uint64(2**64 - 1))
    for b in range(width):
        if constant >> b & 1:
            columns[b].append(full)
    for b in range(width):
        col = columns[b]
        while len(col) > 2:
            x, y, z = col.pop(), col.pop(), col.pop()
            t = x ^ y
            if b + 1 < width:
                columns[b + 1].append((x & y) | (t & z))
            col.insert(0, t ^ z)
        if len(col) == 2:
            x, y = col.pop(), col.pop()
            if b + 1 < width:
                columns[b + 1].append(x & y)
            col.append(x ^ y)
    zero = np.zeros(words, np.uint64)
    return np.stack([c[0] if c else zero for c in columns])


def top_rows(slices: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k highest scores among ``allowed``, ties to the lowest row: not in order."""
    sure, even = np.zeros_like(allowed), allowed.copy()
    have, left = 0, int(np.bitwise_count(even).sum())
    for b in range(len(slices) - 1, -1, -1):
        if have + left <= k:
            break
        ones = even & (~slices[b] if b == len(slices) - 1 else slices[b])
        n = int(np.bitwise_count(ones).sum())
        if have + n >= k:
            even, left = ones, n
        else:
            sure, have, even, left = sure | ones, have + n, even & ~ones, left - n
    rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    return np.concatenate([rows(sure), rows(even)[: max(0, k - have)]])


def search_segment(ids: np.ndarray, slices: list[np.ndarray], queries: Iterator[tuple[int, np.ndarray]], k: int) -> Iterator[tuple[int, int, int]]:
    """(number of the query, row id, score) of each query's winners in one segment; ``ids`` ascend."""
    n, words = len(ids), -(-len(ids) // 64)
    every = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
    for number, (query, vector) in enumerate(queries):
        allowed = every.copy()
        for own in range(*np.searchsorted(ids, [query, query + 1])):
            allowed[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        total = score_slices(slices, vector)
        for r in top_rows(total, allowed, k):
            bits = (total[:, r // 64] >> np.uint64(r % 64) & np.uint64(1)).tolist()
            yield number, int(ids[r]), sum(b << i for i, b in enumerate(bits)) - (bits[-1] << len(bits))


def quantise(vectors: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """vec_id, q, row: every row that takes part, written once, with a number of its own."""
    rows = vectors.select("vec_id", quantised(F.col("embedding"), p.scale).alias("q")).where(F.col("q").isNotNull() & F.col("vec_id").isNotNull() & (F.size("q") > 0))
    return common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "quantised")


def index(rows: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """segment, size, ids, bits, slices: the bitmaps of all ``rows``, written once. Rows with one id spread over segments."""
    segments = max(1, -(-rows.count() // p.segment_rows))
    placed = rows.select(F.pmod(F.xxhash64("row"), F.lit(segments)).cast("int").alias("segment"), F.size("q").alias("size"), "vec_id", "q")
    grouped = placed.groupBy("segment", "size").agg(F.collect_list(F.struct("vec_id", "q")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, size, members in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids = members.values.field("vec_id").to_numpy().astype(np.int64)
                values = members.values.field("q").flatten().to_numpy().reshape(len(ids), size.as_py())
                order = np.lexsort((*values.T[::-1], ids))
                maps = [bitmaps(integers(values[order, j])) for j in range(values.shape[1])]
                row = [[segment.as_py()], [size.as_py()], [ids[order].tobytes()], [[len(m) for m in maps]], [b"".join(m.tobytes() for m in maps)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary()))], ["segment", "size", "ids", "bits", "slices"])

    return common.materialize(grouped.mapInArrow(run, "segment int, size int, ids binary, bits array<int>, slices binary"), "bitmaps")


def search(indexed: DataFrame, queries: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """query_id, rank, vec_id, score for ``queries(vec_id, q)`` against all rows of ``indexed``."""
    wanted = queries.select(F.col("vec_id").alias("query_id"), "q").distinct().withColumn("number", F.monotonically_increasing_id())
    wanted = common.materialize(wanted, "queries")  # numbers stay what they are
    blocks, segments = max(1, -(-wanted.count() // p.query_block)), (indexed.agg(F.max("segment")).first()[0] or 0) + 1
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = wanted.groupBy(F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("number", "query_id", "q")).alias("queries"))
    units = indexed.withColumn("block", many(blocks)).join(block.withColumn("segment", many(segments)).hint("merge"), ["segment", "block"])
    k = p.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in range(len(batch)):
                ids_, bits, blob, asked = (batch.column(c)[u] for c in range(4))
                ids, at, slices = np.frombuffer(ids_.as_py(), np.int64), 0, []
                flat, words = np.frombuffer(blob.as_py(), np.uint64), -(-len(ids) // 64)
                for b in bits.as_py():
                    slices.append(flat[at : at + b * words].reshape(b, words))
                    at += b * words
                fitting = [x for x in asked.as_py() if len(x["q"]) == len(slices)]
                found = list(search_segment(ids, slices, ((x["query_id"], integers(x["q"])) for x in fitting), k))
                columns = [[fitting[i]["number"] for i, _, _ in found], [fitting[i]["query_id"] for i, _, _ in found], [v for _, v, _ in found], [s for _, _, s in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["number", "query_id", "vec_id", "score"])

    found = units.select("ids", "bits", "slices", "queries").mapInArrow(run, "number long, query_id long, vec_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
