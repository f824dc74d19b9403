"""Line windows: one row per window, spans in bytes, in one narrow pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("origin", "resource")
#: Windows to a block. Offsets are added up over blocks and within a block, so no array of offsets is long.
BLOCK = 256
MOST = (1 << 31) - 1


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row. As a generator's output the optimizer cannot copy its expression
    into the places that use it; the outer form gives it no filter to infer either."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _starts(rows: Column, step: int, n: Column, first: Column) -> Column:
    """Byte offsets of ``n`` stretches of ``step`` lines, from ``first`` on."""
    size = lambda i: (F.octet_length(F.array_join(F.slice(rows, i * step + 1, F.lit(step)), "\n")) + 1).cast("bigint")
    sums = F.aggregate(F.transform(F.sequence(F.lit(0), n - 2), size), F.array(first), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    return F.when(n > 1, sums).otherwise(F.array(first))


def windows(contents: DataFrame, lines: int = 40, overlap: int = 8) -> DataFrame:
    """origin, resource, seg_no, start, end, first_line, last_line, text of overlapping windows of ``text``.

    All work is on one row's arrays, inside the scan's stage: no shuffle and no prefix sum over lines. A text is split
    once; its windows come in blocks, whose lines are a slice of it, so the work is linear in lines. Empty windows are
    dropped; a final line end opens one more (empty) line.
    """
    if lines <= 0 or overlap < 0 or overlap >= lines:
        raise ValueError("lines must be positive and overlap smaller than lines")
    stride = max(lines - overlap, 1)
    reach = min(BLOCK * stride, MOST)  # lines from one block to the next; windows may be longer than any text
    base = contents.where(F.col("text").isNotNull() & (F.col("text") != "")).select(*KEYS, "text")
    base = _once(base, "_rows", F.split(F.col("text"), "\n", -1)).select(*KEYS, "_rows", F.size("_rows").alias("_n"))
    count = F.when(F.col("_n") <= lines, F.lit(1)).otherwise(1 + F.ceil((F.col("_n") - lines) / stride).cast("int"))
    base = base.withColumn("_count", count).withColumn("_blocks", F.ceil(F.col("_count") / BLOCK).cast("int"))
    base = _once(base, "_offsets", _starts(F.col("_rows"), reach, F.col("_blocks"), F.lit(0).cast("bigint")))
    block = base.select(*KEYS, "_rows", "_n", "_count", F.posexplode_outer("_offsets").alias("_block", "_offset"))
    line = F.col("_block") * reach
    piece = F.slice(F.col("_rows"), line + 1, F.lit(min((BLOCK - 1) * stride + lines, MOST)))
    block = _once(block.select(*KEYS, "_n", "_count", "_block", "_offset", piece.alias("_lines")), "_starts", _starts(F.col("_lines"), stride, F.least(F.lit(BLOCK), F.col("_count") - F.col("_block") * BLOCK), F.col("_offset")))
    seg = block.select(*KEYS, "_lines", "_n", "_block", F.posexplode_outer("_starts").alias("_at", "start"))
    seg = seg.withColumn("seg_no", F.col("_block") * BLOCK + F.col("_at"))
    first = F.col("seg_no") * stride
    last = F.least(first + lines, F.col("_n"))
    body = F.array_join(F.slice(F.col("_lines"), F.col("_at") * stride + 1, F.lit(lines)), "\n")
    whole = F.when(last < F.col("_n"), F.concat(body, F.lit("\n"))).otherwise(body)
    out = seg.select(*KEYS, "seg_no", "start", whole.alias("text"), (first + 1).alias("first_line"), last.alias("_last"), F.col("_n").alias("_n"))
    out = out.withColumn("end", F.col("start") + F.octet_length("text")).where(F.col("end") > F.col("start"))
    last_line = F.when((F.col("_last") == F.col("_n")) & F.col("text").endswith("\n"), F.col("_last") - 1).otherwise(F.col("_last"))
    return out.select(*KEYS, "seg_no", "start", "end", "first_line", F.greatest(last_line, F.col("first_line")).alias("last_line"), "text")
