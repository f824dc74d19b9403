"""The cluster tree: greedy agglomerative rounds over a pool of vectors, labels from a classifier, walks down the tree.

A round is sequential by definition (each merge depends on the one before), so it runs in one task over one
dimension's pool, of any size: it holds the vectors and one best partner a record, not the similarities of all pairs.
Time grows with the square of the pool, which shrinks as rows merge. A block column clusters every block of a round on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenix.functions import identity
from lumenix.sources import scratch


@dataclass(frozen=True)
class Agglomerative:
    threshold: float = 0.70
    min_cluster: int = 5
    max_cluster: int = 15

    def round(self, vectors: np.ndarray) -> list[list[int]]:
        """Groups of row numbers in merge order; rows in no group stay orphans.

        Each row keeps its best partner as it was when last looked up. Since every merge looks up its new centre, a pair is
        known to the later of its two; so what a row keeps bounds what it can still reach, and it is looked up again only if it
        comes first while its partner has changed. A look-up is a product in single precision, which leaves a few candidates,
        and then exact; rows that cannot merge any more are taken out. Memory is O(n d). Ties fall to the lowest pair.
        """
        n = len(vectors)
        if n < max(self.min_cluster, 2):
            return []
        cap = self.max_cluster or n
        centre = np.array(vectors, np.float64)
        if not np.isfinite(centre).all():
            return []
        scale = max(1.0, float(np.linalg.norm(centre, axis=1).max()))
        margin = 4 * (centre.shape[1] + 8) * 2.0**-24
        groups: list[list[int]] = [[i] for i in range(n)]
        # Rows that may still merge, in order; of those that are out, the size is above the cap until they are taken out.
        row, size = np.arange(n), np.ones(n, np.int64)
        low = (centre / scale).astype(np.float32)
        top, partner = np.full(n, np.inf), np.full(n, -1)
        version, known = np.zeros(n, np.int64), np.zeros(n, np.int64)

        def stale(at: np.ndarray) -> np.ndarray:
            p = partner[at]
            return (p < 0) | (size[p] > cap) | (version[p] != known[at])

        def look_up(at: np.ndarray) -> None:
            near = low[at] @ low.T
            for k, i in enumerate(at):
                s = near[k]
                np.putmask(s, size > cap - size[i], -np.inf)
                s[i] = -np.inf
                most = s.max()
                if not most * scale * scale >= self.threshold - margin * scale * scale:
                    top[i], partner[i] = -np.inf, -1
                    continue
                found = np.flatnonzero(s >= most - margin)
                exact = (centre[found] * centre[i]).sum(1)
                best = exact.max()
                found = found[exact == best]
                top[i], partner[i], known[i] = best, found[0], version[found[0]]
                told = found[(top[found] < best) | ((top[found] == best) & ~stale(found) & (i < partner[found]))]
                top[told], partner[told], known[told] = best, i, version[i]

        several = max(1, min(64, (1 << 22) // n))
        for lo in range(0, n, several):
            look_up(np.arange(lo, min(lo + several, n)))
        # Rows that are likely to come first soon are looked up together, as many as have lately proved worth it.
        out, ahead, early = 0, several, np.zeros(n, bool)
        while len(row):
            i = int(top.argmax())
            if not top[i] >= self.threshold:
                break
            if stale(np.array([i]))[0]:
                ahead = max(1, ahead // 2) if early[i] else ahead
                early[i] = False
                look = np.array([i])
                if ahead > 1:
                    first = np.argpartition(top, -min(2 * ahead, len(top)))[-2 * ahead :]
                    first = first[(top[first] >= self.threshold) & stale(first) & (first != i)]
                    first = first[np.argsort(-top[first])][: ahead - 1]
                    early[first] = True
                    look = np.concatenate([look, first])
                look_up(look)
                continue
            if early[i]:
                ahead, early[i] = min(ahead + 1, several), False
            i, j = sorted((i, int(partner[i])))
            a, b = int(row[i]), int(row[j])
            groups[a] += groups[b]
            groups[b] = []
            size[i] += size[j]
            size[j], top[j] = cap + 1, -np.inf
            mean = np.asarray(vectors)[groups[a]].astype(np.float64).mean(0)
            length = np.linalg.norm(mean)
            centre[i] = mean / length if length > 0 else mean
            low[i] = centre[i] / scale
            version[i] += 1
            out += 1
            if size[i] >= cap:
                size[i], top[i] = cap + 1, -np.inf
                out += 1
            else:
                look_up(np.array([i]))
            if 4 * out > len(row):
                keep = np.flatnonzero(size <= cap)
                moved = np.full(len(row) + 1, -1)
                moved[keep] = np.arange(len(keep))
                row, size, top, version, known, early, centre, low = (x[keep] for x in (row, size, top, version, known, early, centre, low))
                partner, out = moved[partner[keep]], 0
        return [g for g in groups if len(g) >= self.min_cluster and g]


def cluster_round(pool: DataFrame, how: Agglomerative, block: str | None = None) -> DataFrame:
    """group, nth, id of the members of one round over ``pool(no, id, vec)``, ordered by ``no``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no").reset_index(drop=True)
        groups = how.round(np.array(pdf["vec"].tolist(), np.float64)) if len(pdf) else []
        rows = [(f"{pdf['no'].iloc[g[0]]}", k, pdf["id"].iloc[m]) for g in groups for k, m in enumerate(g)]
        return pd.DataFrame(rows, columns=["group", "nth", "id"])

    keyed = pool.withColumn("block", F.col(block) if block else F.lit(0))
    return keyed.select("block", "no", "id", "vec").groupBy("block").applyInPandas(run, "group string, nth int, id string")


@dataclass(frozen=True)
class TreeParams:
    threshold: float = 0.70
    min_cluster: int = 5
    max_cluster: int = 15
    max_levels: int = 3
    min_remaining: int = 8


@dataclass
class Tree:
    """Clusters (key, level, label, vec), edges (parent, child) and the levels built."""

    clusters: DataFrame
    edges: DataFrame
    levels: list[int]
    unlabeled: int
    reused: int


def fabricate(
    level0: DataFrame,
    params: TreeParams,
    label: Callable[[list[list[str]], int], list[str | None]],
    embed: Callable[[str], list[float]],
    fingerprint: str = "",
    known: dict[str, str] | None = None,
) -> Tree:
    """Levels of clusters over ``level0(id, descriptor, vec)``, rows in order of ``no``.

    Each level: one round, one call that labels all groups not known from an earlier run, one vector per label.
    Groups left without a label dissolve into orphans, which join the next round; the level counter goes on. The
    rounds run on the driver, which holds the pool, its vectors as one matrix.
    """
    spark = level0.sparkSession
    how = Agglomerative(params.threshold, params.min_cluster, params.max_cluster)
    table = level0.where(F.col("vec").isNotNull() & (F.size("vec") > 0)).orderBy("no").select("id", "descriptor", "vec").toArrow().combine_chunks()
    pool = list(zip(table["id"].to_pylist(), table["descriptor"].to_pylist()))
    vectors = np.zeros((0, 0))
    if pool:
        vectors = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len({*table["vec"].combine_chunks().value_lengths().to_pylist()}) > 1:
            raise ValueError("the vectors have several widths")
        vectors = vectors.reshape(len(pool), -1)
    del table
    clusters: list[tuple] = []
    edges: list[tuple] = []
    built, level, unlabeled, reused = 0, 1, 0, 0
    while level <= params.max_levels and len(pool) > params.min_remaining:
        groups = how.round(vectors)
        if not groups:
            break
        keys = [identity.cluster_key_of(fingerprint, [pool[i][0] for i in g]) for g in groups]
        owed = [k for k, key in enumerate(keys) if key not in (known or {})]
        labels: dict[int, str | None] = {k: known[key] for k, key in enumerate(keys) if known and key in known}
        reused += len(labels)
        if owed:
            answers = label([[pool[i][1] for i in groups[k] if pool[i][1]] for k in owed], level)
            if len(answers) != len(owed):
                raise ValueError("the classifier answered for another number of groups")
            labels |= dict(zip(owed, answers))
        grouped: set[int] = set()
        fresh, made = [], []
        for k, g in enumerate(groups):
            if not labels[k]:
                unlabeled += 1
                continue
            v = [float(x) for x in embed(labels[k])]
            clusters.append((keys[k], level, labels[k], v))
            edges += [(keys[k], pool[i][0]) for i in sorted(g, key=lambda i: pool[i][0])]
            fresh.append((keys[k], labels[k]))
            made.append(v)
            grouped.update(g)
        if fresh:
            built = level
            left = np.array([i for i in range(len(pool)) if i not in grouped], np.int64)
            vectors = np.concatenate([np.array(made, np.float64), vectors[left]]) if len(left) else np.array(made, np.float64)
        pool = fresh + [p for i, p in enumerate(pool) if i not in grouped]
        level += 1
    return Tree(
        spark.createDataFrame(clusters, "key string, level int, label string, vec array<double>"),
        spark.createDataFrame(edges, "parent string, child string"),
        list(range(built + 1)),
        unlabeled,
        reused,
    )


def leaves(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """cluster, leaf of all segments below each of ``roots(cluster)``, to the fixpoint: trees of any depth, and cycles end
    because pairs are visited once.

    Semi-naive: each round joins only the pairs found last with the edges, and is written to the shared folder.
    """
    parents = edges.select(F.col("parent").alias("p")).distinct()
    frontier = seen = scratch.materialize(roots.select("cluster", F.col("cluster").alias("node")).distinct(), "frontier")
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("node") == F.col("parent")).select("cluster", F.col("child").alias("node")).distinct()
        frontier = scratch.materialize(step.join(seen, ["cluster", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen.join(parents, F.col("node") == F.col("p"), "left_anti").select("cluster", F.col("node").alias("leaf")).where("cluster <> leaf")


def members_by_file(members: DataFrame) -> DataFrame:
    """How many of a cluster's windows each file holds."""
    return members.groupBy("cluster", "resource").agg(F.count(F.lit(1)).alias("windows")).orderBy("cluster", F.desc("windows"), "resource")


def orphans(pool: DataFrame, grouped: DataFrame) -> DataFrame:
    return pool.join(grouped.select("id"), "id", "left_anti")


def pairs(pool: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """All pairs of a pool of any size whose similarity reaches the threshold: a, b, similarity.

    Rows are spread over blocks of about ``block``; a unit is two blocks, compared in numpy, so a task holds two blocks and
    each row moves once for every other block.
    """
    blocks = max(1, -(-pool.count() // block))
    own = pool.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    units = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "vec")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = int(pdf["x"].iloc[0])
        left = pdf[pdf["own"] == x].sort_values("id").reset_index(drop=True)
        right = left if x == int(pdf["y"].iloc[0]) else pdf[pdf["own"] != x].sort_values("id").reset_index(drop=True)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": left["id"][:0], "b": left["id"][:0], "similarity": np.zeros(0)})
        s = np.array(left["vec"].tolist(), np.float64) @ np.array(right["vec"].tolist(), np.float64).T
        i, j = np.nonzero(s >= threshold)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        ok = j > i if right is left else a != b
        first = a[ok] <= b[ok]
        return pd.DataFrame({"a": np.where(first, a[ok], b[ok]), "b": np.where(first, b[ok], a[ok]), "similarity": s[i[ok], j[ok]]})

    kind = pool.schema["id"].dataType.simpleString()
    return units.groupBy("x", "y").applyInPandas(run, f"a {kind}, b {kind}, similarity double")
