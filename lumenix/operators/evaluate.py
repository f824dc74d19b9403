"""Ranking evaluation against graded line ranges: gain, recall, reciprocal rank, slices, intrusions, weight sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validate(queries: DataFrame, qrels: DataFrame) -> None:
    """Every query but those of kind ``absent`` has judgments; those have none above grade 0."""
    judged = qrels.where(F.col("grade") > 0).select("query_id").distinct()
    q = queries.select(F.col("id").alias("query_id"), (F.col("kind") == "absent").alias("absent"))
    wrong = q.join(judged.withColumn("judged", F.lit(True)), "query_id", "left").where(F.col("absent") == F.coalesce("judged", F.lit(False)))
    if names := [r[0] for r in wrong.orderBy("query_id").limit(20).collect()]:
        raise ValueError(f"judgments do not fit these queries: {names}")


def holders(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, passage, doc_id, text of every document of ``documents(doc_id, text)`` that holds a passage of
    ``passages(query_id, passage)``, a stated query set.

    White space in a passage bounds its inner words in any text that holds it, so such a text has the longest of them as a
    word: texts are looked through once for these words, the join is by word, and the passage itself decides. The passages are
    sent to the texts, so no text moves. Passages of fewer than three words have no inner word; only for them, if there are
    any, every text is tried.
    """
    words = lambda c: F.split(c, r"[ \n\t\r]+")
    inner = F.slice(words(F.col("passage")), F.lit(2), F.greatest(F.size(words(F.col("passage"))) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = passages.withColumn("anchor", longest)
    anchors = keyed.agg(F.coalesce(F.collect_set("anchor"), F.array().cast("array<string>")).alias("a")).scalar()
    met = documents.withColumn("anchor", F.explode(F.array_intersect(words(F.col("text")), anchors)))
    found = met.join(F.broadcast(keyed), "anchor").where(F.expr("contains(text, passage)")).drop("anchor")
    short = passages.join(keyed.where(F.col("anchor").isNotNull()).select("query_id"), "query_id", "left_anti")
    if not short.isEmpty():
        found = found.unionByName(documents.join(F.broadcast(short), F.expr("contains(text, passage)")))
    return found


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def _scores(actual: DataFrame, ideal: DataFrame, k: int, prefix: str) -> DataFrame:
    """query_id and ``prefix``_ndcg, _recall, _mrr from graded ranks, ``actual`` and ``ideal`` (query_id, rank, grade)."""
    a = actual.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.count_if(F.col("grade") > 0).alias("found"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first")
    )
    i = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("best"), F.count(F.lit(1)).alias("relevant"))
    both = i.join(a, "query_id", "full")
    ndcg = F.when(F.col("best") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dcg") / F.col("best")))).otherwise(F.lit(0.0))
    return both.select(
        "query_id",
        F.coalesce(ndcg, F.lit(0.0)).alias(f"{prefix}_ndcg"),
        (F.coalesce("found", F.lit(0)) / F.greatest(F.coalesce("relevant", F.lit(0)), F.lit(1))).alias(f"{prefix}_recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias(f"{prefix}_mrr"),
    )


def file_grades(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Each file at its first appearance, ranks closed up, with its best grade (0 if not judged)."""
    first = hits.groupBy("query_id", "resource").agg(F.min("rank").alias("at"))
    best = qrels.groupBy("query_id", "resource").agg(F.max("grade").alias("grade"))
    w = Window.partitionBy("query_id").orderBy("at")
    return first.join(best, ["query_id", "resource"], "left").select("query_id", F.row_number().over(w).alias("rank"), F.coalesce("grade", F.lit(0)).alias("grade"))


def span_grades(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Each hit with the grade of its span: of the judged ranges it overlaps the highest, the last of equals.

    A hit on a range that an earlier hit already claimed is taken out, and later ones move up. A hit without a
    range counts as 0. ``qrels.no`` is the order of judgments.
    """
    j = qrels.select(F.col("query_id"), F.col("resource"), F.col("start_line").alias("js"), F.col("end_line").alias("je"), "grade", "no")
    over = (F.col("start_line") <= F.col("je")) & (F.col("js") <= F.col("end_line"))
    met = hits.join(j, ["query_id", "resource"]).where(over).groupBy("query_id", "rank").agg(F.max(F.struct("grade", "no")).alias("span"))
    every = hits.select("query_id", "rank").join(met, ["query_id", "rank"], "left")
    claim = Window.partitionBy("query_id", F.col("span.no")).orderBy("rank")
    kept = every.withColumn("turn", F.when(F.col("span").isNull(), 1).otherwise(F.row_number().over(claim))).where("turn = 1")
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.select("query_id", F.row_number().over(w).alias("rank"), F.coalesce(F.col("span.grade"), F.lit(0)).alias("grade"))


def _ideal(qrels: DataFrame, by_file: bool) -> DataFrame:
    g = qrels.groupBy("query_id", "resource").agg(F.max("grade").alias("grade")) if by_file else qrels
    return g.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"))).alias("rank"), "grade")


def score_queries(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per query: file and span nDCG, recall, MRR; distinct files over all hits; hits returned (at most k)."""
    q = qrels if "no" in qrels.columns else qrels.withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy("resource", "start_line", "end_line", "grade")))
    counts = hits.groupBy("query_id").agg(F.count_distinct("resource").alias("distinct_files"), F.least(F.count(F.lit(1)), F.lit(k)).alias("returned"))
    files = _scores(file_grades(hits, q), _ideal(q, True), k, "file")
    spans = _scores(span_grades(hits, q), _ideal(q, False), k, "span")
    return files.join(spans, "query_id", "full").join(counts, "query_id", "left").fillna(0, ["distinct_files", "returned"])


METRICS = ["file_ndcg", "file_recall", "file_mrr", "span_ndcg", "span_recall", "span_mrr"]


def mean(report: DataFrame) -> DataFrame:
    return report.agg(*[F.avg(m).alias(m) for m in METRICS], F.round(F.avg("distinct_files")).cast("bigint").alias("distinct_files"), F.round(F.avg("returned")).cast("bigint").alias("returned"))


def slices(report: DataFrame, queries: DataFrame, columns: Sequence[str] = ("form", "facet")) -> DataFrame:
    """Means by each of ``columns`` and overall: one pass over grouping sets."""
    joined = report.join(queries.select(F.col("id").alias("query_id"), *columns), "query_id")
    sets = [[F.col(c)] for c in columns]
    grouped = joined.groupingSets([*sets, []], *columns)
    return grouped.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in METRICS])


def repeat_share(report: DataFrame) -> DataFrame:
    """Share of returned places that repeat a file."""
    return report.agg((F.sum(F.greatest(F.col("returned") - F.col("distinct_files"), F.lit(0))) / F.greatest(F.sum("returned"), F.lit(1))).alias("repeat_share"))


def absent_confidence(hits: DataFrame, queries: DataFrame, origins: Sequence[str]) -> DataFrame:
    """Mean and worst top score of queries proven to have no answer in any searched corpus; how many were not so curated."""
    q = queries.where(F.col("kind") == "absent").select(F.col("id").alias("query_id"), (F.size(F.array_except(F.array(*map(F.lit, origins)), "absent_in")) == 0).alias("curated"))
    top = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    both = q.join(top, "query_id", "left").fillna(0.0, ["top"])
    ok = F.when(F.col("curated"), F.col("top"))
    return both.agg(F.avg(ok).alias("mean_top"), F.max(ok).alias("worst_top"), F.count(ok).alias("scored"), F.count_if(~F.col("curated")).alias("skipped"))


def intrusions(hits: DataFrame, primary: str, k: int = 10) -> DataFrame:
    """Per query, hits of other corpora among the first k, and their share of the places."""
    top = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.count_if(F.col("origin") != primary).alias("foreign"), F.count(F.lit(1)).alias("places"))
    return top.select("query_id", "foreign", (F.col("foreign") / F.col("places")).alias("share"))


def expand_clusters(hits: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """A cluster hit fills places with its members, in order, up to k. ``members(cluster, resource, start, end, nth)``."""
    m = members.select(F.col("cluster").alias("resource"), F.col("resource").alias("m_resource"), F.col("start").alias("m_start"), F.col("end").alias("m_end"), "nth")
    both = hits.join(m, "resource", "left")
    pick = lambda own, other: F.when((F.col("level") > 0) & F.col("m_resource").isNotNull(), F.col(other)).otherwise(F.col(own))
    out = both.select("query_id", F.col("rank").alias("at"), "nth", pick("resource", "m_resource").alias("resource"), pick("start", "m_start").alias("start"), pick("end", "m_end").alias("end"))
    w = Window.partitionBy("query_id").orderBy("at", F.coalesce("nth", F.lit(0)))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "resource", "start", "end")


def refuse_pool(pool: DataFrame, weights: Mapping[str, float], k: int, how: str = "mean") -> DataFrame:
    """Harness re-fusion of a pool of hits (query_id, location, per_dimension): divides by all asked weights at any level."""
    total = sum(weights.values())
    part = lambda d: F.coalesce(F.element_at("per_dimension", d), F.lit(0.0))
    score = sum((part(d) * w for d, w in weights.items()), F.lit(0.0)) / total if how == "mean" else F.greatest(*[part(d) for d in weights], F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "origin", "resource", "start")
    return pool.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def half(query_id: Column) -> Column:
    """0: tune on it, 1: report on it."""
    return F.crc32(query_id.cast("string")) % 2


def weight_sweep(pool: DataFrame, qrels: DataFrame, grid: Sequence[Mapping[str, float]], k: int = 10) -> DataFrame:
    """Mean file nDCG of every weight setting on the tuning half: the grid is exploded beside the stored scores, one plan."""
    names = sorted({n for g in grid for n in g})
    settings = F.array(*[F.struct(F.lit(i).alias("setting"), *[F.lit(float(g.get(n, 0.0))).alias(n) for n in names]) for i, g in enumerate(grid)])
    each = pool.where(half(F.col("query_id")) == 0).withColumn("g", F.explode(settings))
    total = sum((F.col(f"g.{n}") for n in names), F.lit(0.0))
    score = sum((F.coalesce(F.element_at("per_dimension", n), F.lit(0.0)) * F.col(f"g.{n}") for n in names), F.lit(0.0)) / total
    key = F.concat_ws("#", F.col("g.setting").cast("string"), F.col("query_id").cast("string"))
    w = Window.partitionBy("g.setting", "query_id").orderBy(F.desc("score"), "origin", "resource", "start")
    ranked = each.withColumn("score", score).withColumn("rank", F.row_number().over(w)).select(key.alias("query_id"), "rank", "resource")
    judged = qrels.where(half(F.col("query_id")) == 0).withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    judged = judged.withColumn("query_id", F.concat_ws("#", F.col("setting").cast("string"), F.col("query_id").cast("string")))
    out = _scores(file_grades(ranked, judged), _ideal(judged, True), k, "file")
    return out.groupBy(F.substring_index("query_id", "#", 1).cast("int").alias("setting")).agg(F.avg("file_ndcg").alias("file_ndcg"))


def subsets(names: Sequence[str]) -> list[tuple[str, ...]]:
    """All non-empty subsets of dimensions, small ones first: what a dimension benchmark loops over."""
    from itertools import combinations

    return [c for n in range(1, len(names) + 1) for c in combinations(names, n)]


def subset_scores(pool: DataFrame, qrels: DataFrame, names: Sequence[str], k: int = 10) -> DataFrame:
    """dimensions, file_ndcg of every subset, on the tuning half: each dimension asked with weight 1 or not at all."""
    all_ = subsets(names)
    swept = weight_sweep(pool, qrels, [{n: float(n in c) for n in names} for c in all_], k)
    label = F.get(F.array(*[F.lit("+".join(c)) for c in all_]), F.col("setting"))
    return swept.select(label.alias("dimensions"), "file_ndcg")


def compare(report: DataFrame, baseline: DataFrame, mark: float = 0.0005) -> DataFrame:
    """Per query and metric, the change from a stored baseline: ``+``, ``-`` or ``=`` within the mark."""
    names = ["file_ndcg", "file_recall", "span_ndcg", "span_recall"]
    b = baseline.select("query_id", *[F.col(n).alias(f"base_{n}") for n in names])
    both = report.join(b, "query_id")
    sign = lambda n: F.when(F.col(n) - F.col(f"base_{n}") > mark, "+").when(F.col(n) - F.col(f"base_{n}") < -mark, "-").otherwise("=")
    return both.select("query_id", *[x for n in names for x in ((F.col(n) - F.col(f"base_{n}")).alias(f"delta_{n}"), sign(n).alias(f"mark_{n}"))])


def save(report: DataFrame, path: str) -> None:
    """One JSON row per query and one, ``__mean__``, over all."""
    names = ["file_ndcg", "file_recall", "span_ndcg", "span_recall"]
    overall = report.agg(*[F.avg(n).alias(n) for n in names]).select(F.lit("__mean__").alias("query_id"), *names)
    report.select(F.col("query_id").cast("string").alias("query_id"), *names).unionByName(overall).coalesce(1).write.mode("overwrite").json(path)
