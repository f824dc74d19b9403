"""Skew-safe grouping and look-ups: rows meet what belongs to their key without a hot key's rows meeting in one task.

A key that holds a thousandth of all rows or more is hot. There are a thousand of those at most, so the list of their
hashes is bounded; they are joined over ``SALTS`` salts, all others plainly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
HOT_ROWS = 1000
SALTS = 64
SIEVE_BITS = 1 << 24


def _salted(rows: DataFrame, counts: DataFrame, found: DataFrame, keys: list[str], how: str, row_salt: list[str] | None) -> DataFrame:
    """``rows`` joined with ``found`` (few rows per key); ``counts`` has the keys and their ``group_rows``."""
    route, total = F.xxhash64(*keys), rows.count()
    crowded = counts.where((F.col("group_rows") > HOT_ROWS) & (F.col("group_rows") * HOT_SHARE >= total)) if total > HOT_ROWS else None
    hot = [] if crowded is None else [r[0] for r in crowded.select(route).limit(HOT_SHARE + 1).collect()]
    if not hot:
        return rows.join(found, keys, how)
    is_hot = F.broadcast(rows.sparkSession.createDataFrame([(h, True) for h in set(hot)], "hot_route long, is_hot boolean"))
    salt = F.pmod(F.xxhash64(*(row_salt or rows.columns)), F.lit(SALTS)).cast("int")
    left = rows.withColumn("hot_route", route).join(is_hot, "hot_route", "left").withColumn("salt", F.when(F.col("is_hot"), salt).otherwise(F.lit(0)))
    spread = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = found.withColumn("hot_route", route).join(is_hot, "hot_route", "left").withColumn("salt", F.explode(spread))
    return left.drop("hot_route", "is_hot").join(right.drop("hot_route", "is_hot"), [*keys, "salt"], how).drop("salt")


def attach(rows: DataFrame, keys: list[str], aggregates: list[Column], at_least: int = 1, row_salt: list[str] | None = None) -> DataFrame:
    """``rows`` with ``group_rows`` and ``aggregates`` over equal ``keys``; groups under ``at_least`` rows are left out.

    Aggregation combines on the map side. ``rows`` is read several times and must be cheap to read: a written table.
    """
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"), *aggregates)
    if at_least > 1:
        found = found.where(F.col("group_rows") >= at_least)
    return _salted(rows, found, found, keys, "inner", row_salt)


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner", row_salt: list[str] | None = None) -> DataFrame:
    """``rows`` joined with ``found``, which has few rows per key. ``rows`` is read several times: a written table."""
    return _salted(rows, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows")), found, keys, how, row_salt)


def sieve(rows: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """``rows`` whose key may be in ``found``, a written table: none that is goes missing, few others stay.

    A bitmap of ``SIEVE_BITS`` bits, hence of bounded size, is broadcast, so that wide rows without a partner are not shuffled
    for the exact join that follows. With far more keys than bits it lets everything pass.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(SIEVE_BITS))
    bit = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("sieve_at") % 64).cast("int"))
    words = found.select(at.alias("sieve_at")).groupBy(F.shiftright("sieve_at", 6).alias("sieve_word")).agg(F.bit_or(bit()).alias("sieve_bits"))
    met = rows.withColumn("sieve_at", at).join(F.broadcast(words), F.shiftright("sieve_at", 6) == F.col("sieve_word"))
    return met.where(F.col("sieve_bits").bitwiseAND(bit()) != 0).drop("sieve_at", "sieve_word", "sieve_bits")
