"""Scoring: postings and statistics, BM25, cosine, term coverage, fusion.

A *record* is a searchable slot of one dimension at one level, located by (origin, resource, start, end).
Every scorer returns the location, the level and a score in (0, 1]; absent means zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenix.functions import text as tx
from lumenix.functions import vectors as vec
from lumenix.sources import scratch

PLACE = ["origin", "resource", "start", "end"]
K1, B = 1.2, 0.75


def term_records(records: DataFrame, *more: str) -> DataFrame:
    """Records with ``terms`` (an array) to one row per record: location, level, terms, len, and further columns named."""
    return records.select(*PLACE, "level", "terms", F.size("terms").cast("bigint").alias("len"), *more)


def structural(segments: DataFrame, *more: str) -> DataFrame:
    """The structural dimension: all terms of each window. An empty window keeps its slot."""
    return term_records(segments.withColumn("terms", tx.terms(F.col("text"))).withColumn("level", F.lit(0)), *more)


def postings(records: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """origin, resource, start, end, level, len, term, tf.

    ``wanted`` terms are filtered inside each record's array, so only matches are exploded and shuffled. The
    record's length travels along; no join brings it back.
    """
    terms = F.col("terms") if wanted is None else F.filter("terms", lambda t: t.isin(wanted))
    return records.select(*PLACE, "level", "len", F.explode(terms).alias("term")).groupBy(*PLACE, "level", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def matched(records: DataFrame, wanted: list[str]) -> DataFrame:
    """All records with their lengths, but only the ``wanted`` ones of their terms: what statistics and scores of one query
    need, so that records are cut and read once for both."""
    return records.select(*PLACE, "level", F.filter("terms", lambda t: t.isin(wanted)).alias("terms"), "len")


@dataclass(frozen=True)
class CorpusStats:
    """Mergeable statistics of one dimension: slots, total length as average times slots, document frequencies."""

    records: int
    total_length: float
    frequency: dict[str, int]

    @property
    def average(self) -> float:
        return self.total_length / self.records if self.records else 0.0

    def merge(self, other: "CorpusStats") -> "CorpusStats":
        df = dict(self.frequency)
        for t, n in other.frequency.items():
            df[t] = df.get(t, 0) + n
        return CorpusStats(self.records + other.records, self.total_length + other.total_length, df)


def statistics(records: DataFrame, wanted: list[str]) -> DataFrame:
    """Per origin: records, avg_len (of slots that are not empty), total_length, and df_0... of the wanted terms.

    One pass with partial aggregation; nothing is exploded.
    """
    df = [F.sum(F.array_contains("terms", t).cast("bigint")).alias(f"df_{i}") for i, t in enumerate(wanted)]
    slim = records.groupBy("origin").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.avg(F.when(F.col("len") > 0, F.col("len"))), F.lit(0.0)).alias("avg_len"), *df)
    return slim.withColumn("total_length", F.col("avg_len") * F.col("records"))


def federated_stats(records: DataFrame, wanted: list[str]) -> CorpusStats:
    """Statistics of every origin, summed before anyone scores (a handful of numbers per origin reach the driver)."""
    total = CorpusStats(0, 0.0, {})
    for r in statistics(records, wanted).collect():
        total = total.merge(CorpusStats(r["records"], r["total_length"], {t: r[f"df_{i}"] for i, t in enumerate(wanted)}))
    return total


def idf(n: Column | int, df: Column | int) -> Column:
    n, df = (x if isinstance(x, Column) else F.lit(x) for x in (n, df))
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """Distinct terms in order of appearance: the same expression as over the corpus, folded on the driver."""
    return list(spark.range(1).select(F.array_distinct(tx.terms(F.lit(query)))).first()[0])


def bm25(records: DataFrame, wanted: list[str], stats: CorpusStats) -> DataFrame:
    """Location, level, score: BM25 as a share of the query's ceiling, positive ones only."""
    import math

    weight = {t: math.log((stats.records - n + 0.5) / (n + 0.5) + 1) for t, n in stats.frequency.items() if n > 0 and t in wanted}
    if not weight:
        return records.select(*PLACE, "level", F.lit(0.0).alias("score")).where(F.lit(False))
    ceiling = sum(w * (K1 + 1) for w in weight.values())
    of = F.create_map(*[F.lit(x) for t, w in weight.items() for x in (t, w)])
    length = 1 - B + B * F.col("len") / max(stats.average, 1.0)
    part = F.element_at(of, F.col("term")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    raw = postings(records, list(weight)).groupBy(*PLACE, "level").agg(F.sum(part).alias("raw"))
    return raw.where("raw > 0").select(*PLACE, "level", F.least(F.col("raw") / ceiling, F.lit(1.0)).alias("score"))


def frequency_records(records: DataFrame, *more: str) -> DataFrame:
    """Records with a stored ``descriptor`` back to terms; prose descriptors are split at white space, case kept."""
    entries = tx.decode_frequencies(F.col("descriptor"))
    terms = F.flatten(F.transform(entries, lambda e: F.array_repeat(e["term"], F.least(e["tf"], F.lit(1_000_000)).cast("int"))))
    return term_records(records.withColumn("terms", terms), *more)


def cosine(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Location, level, score of unit vectors against one query vector, a literal in the scan's stage. Only positive
    products count, at most 1; other widths are skipped."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.size("vec") == len(query)).withColumn("score", vec.dot(F.col("vec"), q))
    return scored.where(F.col("score") > 0).select(*PLACE, "level", F.least("score", F.lit(1.0)).alias("score"))


def coverage(contents: DataFrame, wanted: list[str], limit: int) -> DataFrame:
    """The term-coverage baseline: files by distinct query terms, then matching (line, term) pairs, then key; each with
    its densest line (the first of equals) and its share of the query's terms."""
    rows = contents.select("origin", "resource", F.posexplode(tx.lines(F.col("text"))).alias("at", "line"))
    hit = rows.withColumn("found", F.array_intersect(F.array_distinct(tx.terms(F.col("line"))), F.array(*[F.lit(t) for t in wanted]))).withColumn("n", F.size("found")).where("n > 0")
    covered = [F.max(F.array_contains("found", t).cast("int")) for t in wanted]
    files = hit.groupBy("origin", "resource").agg(
        sum(covered[1:], covered[0]).alias("coverage"), F.sum("n").cast("bigint").alias("total"), F.max(F.struct("n", (-F.col("at")).alias("at"))).alias("best")
    )
    out = files.select("origin", "resource", "coverage", "total", (1 - F.col("best.at")).alias("line"), (F.col("coverage") / len(wanted)).alias("confidence"))
    return out.orderBy(F.desc("coverage"), F.desc("total"), "resource", "origin").limit(limit)


def fuse(scored: dict[str, DataFrame], weights: dict[str, float], applicable: dict[int, list[str]], how: str = "mean") -> DataFrame:
    """One row per candidate: location, level, score, per_dimension.

    ``mean``: weighted sum over the weights of all asked dimensions that hold records at the candidate's level, whether
    they matched or not; no usable weight gives 0. ``max``: the best dimension. Dimensions are unioned and grouped by
    location, so a candidate needs no match in all of them.
    """
    rows: DataFrame | None = None
    for name, df in scored.items():
        part = df.select(*PLACE, "level", F.lit(name).alias("dimension"), F.lit(float(weights.get(name, 1.0))).alias("weight"), "score")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no dimension to score")
    agg = rows.groupBy(*PLACE, "level").agg(
        F.sum(F.col("weight") * F.col("score")).alias("numerator"), F.max("score").alias("best"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "score")))).alias("per_dimension")
    )
    total = F.lit(0.0)
    for level, names in applicable.items():
        total = F.when(F.col("level") == level, F.lit(float(sum(weights.get(n, 1.0) for n in names)))).otherwise(total)
    mean = F.when((total > 0) & (total < float("inf")), F.col("numerator") / total).otherwise(F.lit(0.0))
    return agg.select(*PLACE, "level", (mean if how == "mean" else F.col("best")).alias("score"), "per_dimension")


def rank(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Best first; ties by origin, resource, start (then level and end, for a total order)."""
    out = hits.orderBy(F.desc("score"), "origin", "resource", "start", "level", "end")
    return out if limit is None else out.limit(limit)


#: Scores of so many (record, query) pairs are held at once; so many candidates a place are kept before they are cut to the best.
CELLS, SLACK = 1 << 20, 4


def bm25_batch(records: DataFrame, queries: DataFrame, limit: int | None = None, *more: str) -> DataFrame:
    """BM25 of many queries at once: query_id, location, level, score, further columns named[, rank].

    ``queries(query_id, text)`` is a stated set: the driver sends its terms and their weights to the tasks. Records are cut
    once, to a written table of their asked terms; each is scored for all queries where it is read, and a task returns no more
    than its best ``limit`` of a query. So what is written grows with the records and what is shuffled with the tasks, neither
    with records times queries. Records at the same place are one.
    """
    import math

    from pyspark.sql import Window

    asked = {(r[0], r[1]) for r in queries.select("query_id", F.explode(tx.terms(F.col("text"))).alias("term")).distinct().collect()}
    place = [*PLACE, "level", "len", *more]
    slim = scratch.materialize(records.select(*place, F.filter("terms", lambda t: t.isin(sorted({t for _, t in asked}))).alias("terms")), "asked")
    twice = slim.groupBy(F.xxhash64(*place).alias("_h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h")
    own = slim
    if not twice.isEmpty():
        keyed = slim.withColumn("_h", F.xxhash64(*place))
        merged = keyed.join(twice, "_h", "left_semi").groupBy(*place).agg(F.flatten(F.collect_list("terms")).alias("terms"))
        own = keyed.join(twice, "_h", "left_anti").select(*place, "terms").unionByName(merged)
    df = {r[0]: r[1] for r in own.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect()}
    per = slim.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(F.col("len") > 0, F.col("len"))), F.lit(0.0)).alias("a"))
    n, average = per.agg(F.sum("n"), F.sum(F.col("a") * F.col("n")) / F.sum("n")).first()
    weight = {t: math.log((n - k + 0.5) / (k + 0.5) + 1) for t, k in sorted(df.items())}
    kind = queries.schema["query_id"]
    schema = T.StructType([T.StructField("query_id", kind.dataType), *[slim.schema[c] for c in (*PLACE, "level", *more)], T.StructField("score", T.DoubleType()), T.StructField("key", T.LongType())])
    found = own.mapInArrow(_scorer(sorted(((q, t) for q, t in asked if t in weight), key=lambda x: (str(x[0]), x[1])), weight, max(average or 0.0, 1.0), limit, kind.dataType, [*PLACE, "level", *more]), schema)
    if limit is None:
        return found.drop("key")
    w = Window.partitionBy("query_id").orderBy(F.desc("key"), "origin", "resource", "start")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("key")
    out = scratch.materialize(out, "hits")
    scratch.discard(slim)
    return out


def _scorer(asked: list[tuple], weight: dict[str, float], average: float, limit: int | None, kind: T.DataType, kept: list[str]):  # type: ignore[no-untyped-def]
    """For ``mapInArrow`` over records with ``terms`` and ``len``: (query_id, what is ``kept`` of the record, score, key), the
    key being the score in billionths, by which ranks go."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    words = list(weight)
    number = {t: i for i, t in enumerate(words)}
    ids = list(dict.fromkeys(q for q, _ in asked))
    at = {q: i for i, q in enumerate(ids)}
    by_term = sorted((number[t], at[q]) for q, t in asked)
    idf_of = np.array([weight[t] for t in words])
    askers = np.array([q for _, q in by_term], np.int64)
    degree = np.bincount(np.array([t for t, _ in by_term], np.int64), minlength=len(words))
    begin = np.cumsum(degree) - degree
    ceiling = np.bincount(askers, np.repeat(idf_of, degree) * (K1 + 1), minlength=len(ids))
    order = [("_q", "ascending"), ("key", "descending"), *[(c, "ascending") for c in ("origin", "resource", "start")]]

    def scores(terms, length):  # type: ignore[no-untyped-def]
        """Of some records, by query: the sum of their parts in order of the terms."""
        ends = terms.offsets.to_numpy()
        row = np.repeat(np.arange(len(terms)), np.diff(ends))
        term = pc.index_in(terms.flatten(), value_set=pa.array(words, pa.string())).to_numpy(zero_copy_only=False)
        pair, tf = np.unique(row * len(words) + term.astype(np.int64), return_counts=True)
        row, term = pair // len(words), pair % len(words)
        part = idf_of[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / average))
        times = degree[term]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        cell = np.repeat(row, times) * len(ids) + askers[np.repeat(begin[term], times) + inside]
        return np.bincount(cell, np.repeat(part, times), minlength=len(terms) * len(ids)).reshape(len(terms), len(ids))

    def run(batches):  # type: ignore[no-untyped-def]
        names = pa.array(ids, to_arrow_type(kind))
        least = np.full(len(ids), -1, np.int64)
        held: list = []

        def best():  # type: ignore[no-untyped-def]
            """The best of what is held, and the key that a query's next ones must reach."""
            if not held:
                return None
            whole = pa.Table.from_batches(held).combine_chunks()
            whole = whole.take(pc.sort_indices(whole, sort_keys=order, null_placement="at_start"))
            q = whole["_q"].to_numpy()
            first = np.searchsorted(q, q, "left")
            keep = np.arange(len(q)) - first < limit
            last = np.arange(len(q)) - first == limit - 1
            least[q[last]] = whole["key"].to_numpy()[last]
            return whole.filter(pa.array(keep)).combine_chunks()

        def out(table):  # type: ignore[no-untyped-def]
            for b in table.to_batches():
                yield pa.RecordBatch.from_arrays([names.take(b.column("_q")), *[b.column(c) for c in (*kept, "score", "key")]], ["query_id", *kept, "score", "key"])

        step = max(1, CELLS // max(len(ids), 1))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                terms = batch.column("terms")
                terms = pa.ListArray.from_arrays(pa.array(terms.offsets.to_numpy() - terms.offsets[0].as_py(), pa.int32()), terms.flatten())
                raw = scores(terms, batch.column("len").to_numpy().astype(np.float64))
                score = np.minimum(raw / ceiling, 1.0)
                key = np.floor(score * 1e9 + 0.5).astype(np.int64)
                good = raw > 0
                if limit is not None:
                    good &= key >= least
                    if len(key) > limit and good.sum() > SLACK * limit * len(ids):
                        good &= key >= np.partition(np.where(good, key, -1), len(key) - limit, 0)[len(key) - limit]
                row, q = np.nonzero(good)
                part = pa.RecordBatch.from_arrays([pa.array(q), *[batch.column(c).take(pa.array(row)) for c in kept], pa.array(score[row, q]), pa.array(key[row, q])], ["_q", *kept, "score", "key"])
                if limit is None:
                    yield from out(pa.Table.from_batches([part]))
                    continue
                held.append(part)
                if sum(b.num_rows for b in held) > SLACK * limit * len(ids):
                    held = best().to_batches()
        if limit is not None and held:
            yield from out(best())

    return run
