"""Queries over dimensions, levels and corpora; regions of hits."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenix.operators import score as sc
from lumenix.sources import scratch

MAX_WEIGHT = 1e6


@dataclass(frozen=True)
class Term:
    text: str
    weight: float = 1.0

    def usable(self) -> bool:
        """A blank text, a weight of zero or none at all (NaN) is not asked."""
        return bool(self.text.strip()) and self.weight > 0


@dataclass(frozen=True)
class LevelFilter:
    """All levels, segments (0), clusters (above 0), or the given ones."""

    kind: str = "all"
    only: frozenset[int] = frozenset()

    def allows(self, level: int) -> bool:
        return {"all": True, "segments": level == 0, "clusters": level > 0}.get(self.kind, level in self.only)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.kind == "all":
            return df
        if self.kind == "only":
            return df.where(F.col("level").isin(sorted(self.only)))
        return df.where(F.col("level") == 0 if self.kind == "segments" else F.col("level") > 0)


def parse_levels(spec: str) -> LevelFilter:
    """``all``, ``segments``, ``clusters``, or numbers and upward ranges: ``0,2-4``."""
    word = spec.strip()
    for kind in ("all", "segments", "clusters"):
        if word in (kind, kind.rstrip("s") if kind != "all" else kind):
            return LevelFilter(kind)
    found: set[int] = set()
    for part in (p.strip() for p in spec.split(",")):
        m = re.fullmatch(r"\+?(\d+)\s*(?:-\s*\+?(\d+))?", part)
        if not m or any(int(x) > 65535 for x in m.groups() if x):
            raise ValueError(f"level {part!r} in {spec!r} is neither a number, a range nor a name")
        low, high = int(m[1]), int(m[2] or m[1])
        if low > high:
            raise ValueError(f"range {part!r} in {spec!r} runs downward")
        found.update(range(low, high + 1))
    return LevelFilter("only", frozenset(found))


def parse_dimension(spec: str) -> tuple[str, Term]:
    """``DIM[:WEIGHT]=TEXT``, cut at the first ``=``; the weight is finite, from 0 to a million."""
    head, sep, text = spec.partition("=")
    if not sep:
        raise ValueError(f"{spec!r} is not DIM[:WEIGHT]=TEXT")
    name, colon, raw = head.partition(":")
    weight = 1.0
    if colon:
        try:
            weight = float(raw)
        except ValueError:
            raise ValueError(f"weight {raw!r} in {spec!r} is not a number") from None
        if not math.isfinite(weight) or not 0 <= weight <= MAX_WEIGHT:
            raise ValueError(f"weight {raw!r} in {spec!r} is outside 0 to {MAX_WEIGHT:.0f}")
    if not name:
        raise ValueError(f"{spec!r} names no dimension")
    return name, Term(text, weight)


@dataclass
class Dimension:
    """A built dimension: term records (``terms``, ``len``) or unit vectors (``vec``), never both scored.

    ``levels`` are those that hold records; ``encode`` turns query text into a vector. ``scorer``, if given, maps (table,
    query text) to location, level and a score in (0, 1], in place of BM25 or cosine.
    """

    records: DataFrame | None = None
    vectors: DataFrame | None = None
    encode: object = None
    levels: tuple[int, ...] = (0,)
    fingerprint: str = ""
    scorer: Callable[[DataFrame, str], DataFrame] | None = None


@dataclass
class Index:
    """Dimensions over one or more corpora; rows carry their origin, so a federation is a union."""

    dimensions: dict[str, Dimension] = field(default_factory=dict)
    known: frozenset[str] = frozenset()

    def check(self, query: Mapping[str, Term]) -> dict[str, Term]:
        """The usable part of a query; names of unknown dimensions and of configured ones that are not built are errors."""
        for name in query:
            if name not in self.dimensions:
                state = "configured but not built" if name in self.known else f"unknown; there are {sorted(self.dimensions)}"
                raise ValueError(f"dimension {name!r} is {state}")
        return {n: t for n, t in query.items() if t.usable()}

    def scored(self, query: Mapping[str, Term], levels: LevelFilter) -> dict[str, DataFrame]:
        """Each asked dimension's scores within the levels; a dimension with an embedder is scored by cosine alone."""
        out = {}
        for name, term in query.items():
            d = self.dimensions[name]
            if not any(levels.allows(x) for x in d.levels):
                continue
            if d.scorer is not None:
                out[name] = d.scorer(levels.apply(d.vectors if d.vectors is not None else d.records), term.text)
            elif d.vectors is not None:
                out[name] = sc.cosine(levels.apply(d.vectors), d.encode(term.text))  # type: ignore[operator]
            else:
                wanted = sc.query_terms(d.records.sparkSession, term.text)
                slim = scratch.materialize(sc.matched(d.records, wanted), "matched")
                out[name] = sc.bm25(levels.apply(slim), wanted, sc.federated_stats(slim, wanted))
        return out

    def find_at(self, query: Mapping[str, Term], limit: int | None, levels: LevelFilter = LevelFilter("all"), candidates: DataFrame | None = None) -> DataFrame:
        """Ranked hits: origin, resource, start, end, level, score, per_dimension. ``candidates`` (locations) bound what may score."""
        asked = self.check(query)
        if not asked:
            raise ValueError("the query asks nothing")
        scored = self.scored(asked, levels)
        if not scored:
            raise ValueError("no asked dimension has records at these levels")
        if candidates is not None:
            scored = {n: df.join(candidates.select(*sc.PLACE), sc.PLACE, "left_semi") for n, df in scored.items()}
        applicable: dict[int, list[str]] = {}
        for name in asked:
            for level in self.dimensions[name].levels:
                if levels.allows(level):
                    applicable.setdefault(level, []).append(name)
        return sc.rank(sc.fuse(scored, {n: t.weight for n, t in asked.items()}, applicable), limit)

    def find(self, query: Mapping[str, Term], limit: int = 10) -> DataFrame:
        return self.find_at(query, limit, LevelFilter("segments"))


def federation(members: Mapping[str, Index]) -> Index:
    """One index over several: rows under their member's origin; equal names must have equal fingerprints."""
    out = Index(known=frozenset().union(*(m.known for m in members.values())))
    for origin, member in members.items():
        for name, d in member.dimensions.items():
            tag = lambda df: None if df is None else df.withColumn("origin", F.lit(origin))  # noqa: B023, E731
            if name not in out.dimensions:
                out.dimensions[name] = Dimension(tag(d.records), tag(d.vectors), d.encode, d.levels, d.fingerprint, d.scorer)
                continue
            have = out.dimensions[name]
            if have.fingerprint != d.fingerprint:
                raise ValueError(f"dimension {name!r} was built differently in {origin!r}")
            join = lambda a, b: b if a is None else a if b is None else a.unionByName(b)
            out.dimensions[name] = Dimension(join(have.records, tag(d.records)), join(have.vectors, tag(d.vectors)), have.encode, tuple(sorted({*have.levels, *d.levels})), have.fingerprint, have.scorer)
    return out


# -- regions


def shape(ranked: DataFrame, depths: list[int], per_resource: int, limit: int) -> DataFrame:
    """Regions of a ranked list (``rn``) as read to each depth, in one plan.

    Windows of one resource that overlap or touch form a region, led by its best hit; clusters stand alone. Per
    resource at most ``per_resource`` regions stay (0: all); where the others start is noted on its first.
    """
    by = Window.partitionBy("depth", "origin", "resource", "cluster")
    h = ranked.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).where("rn <= depth")
    h = h.withColumn("cluster", F.when(F.col("level") > 0, F.col("rn")).otherwise(F.lit(0)))
    reach = F.max("end").over(by.orderBy("start", "rn").rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumn("new", F.when(F.col("level") > 0, 1).when(F.col("start") <= reach, 0).otherwise(1))
    h = h.withColumn("island", F.sum("new").over(by.orderBy("start", "rn")))
    runs = h.groupBy("depth", "origin", "resource", "cluster", "island").agg(
        F.min(F.struct((-F.col("score")).alias("o"), "start", "end", "level", "score")).alias("best"), F.min("start").alias("region_start"), F.max("end").alias("region_end"), F.count(F.lit(1)).cast("int").alias("segments")
    )
    runs = runs.select("depth", "origin", "resource", "cluster", F.col("best.start").alias("start"), F.col("best.end").alias("end"), F.col("best.level").alias("level"), F.col("best.score").alias("score"), "region_start", "region_end", "segments")
    place = [F.desc("score"), "origin", "resource", "region_start"]
    runs = runs.withColumn("pos", F.row_number().over(Window.partitionBy("depth").orderBy(*place)))
    own = Window.partitionBy("depth", "origin", "resource", F.col("level") > 0).orderBy("pos")
    runs = runs.withColumn("nth", F.row_number().over(own))
    if per_resource:
        extra = F.collect_list(F.when((F.col("level") == 0) & (F.col("nth") > per_resource), F.col("start"))).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        runs = runs.withColumn("more", F.when((F.col("level") == 0) & (F.col("nth") == 1), extra).otherwise(F.array().cast("array<bigint>")))
        runs = runs.where((F.col("level") > 0) | (F.col("nth") <= per_resource))
    else:
        runs = runs.withColumn("more", F.array().cast("array<bigint>"))
    runs = runs.withColumn("place", F.row_number().over(Window.partitionBy("depth").orderBy("pos"))).where(F.col("place") <= limit)
    size = runs.groupBy("depth").agg(F.count(F.lit(1)).alias("size"))
    # The fullest list wins, the shallowest of equals.
    pick = size.agg(F.max_by("depth", F.struct("size", (-F.col("depth")).alias("d"))).alias("depth"))
    return runs.join(F.broadcast(pick), "depth").select("place", "origin", "resource", "start", "end", "level", "score", "region_start", "region_end", "segments", "more")


def numbered(hits: DataFrame) -> DataFrame:
    """``hits`` with their place ``rn`` in the ranking, written once. The sort is distributed; places are a partition's
    offset plus the row's place there, so no task holds all hits and the driver sees one count a partition."""
    spark = hits.sparkSession
    out = scratch.materialize(sc.rank(hits).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for p, n in out.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((p, before))
        before += n
    table = spark.createDataFrame(offsets, "_part long, _before long")
    return out.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn("rn", (F.col("_before") + at + 1).cast("int")).drop("_part", "_before", "_id")


def regions(hits: DataFrame, per_resource: int = 2, limit: int = 10) -> DataFrame:
    """Regions for the best places, reading as deep as the list needs: ``4 * limit`` hits (20 at least), then twice that, and so on.

    Hits are scored and ranked once; each step reads deeper into the written ranking, and the loop stops once the list is
    full or the hits run out.
    """
    ranked = numbered(hits)
    total = ranked.count()
    depths = [max(4 * limit, 20)]
    while True:
        shaped = shape(ranked.where(F.col("rn") <= depths[-1]), depths, per_resource, limit)
        if total < depths[-1] or shaped.count() >= limit:
            return shaped.orderBy("place")
        depths.append(2 * depths[-1])
