"""Near-duplicate groups: one-permutation MinHash with optimal densification, banded buckets, star-shaped edges.

1. One narrow pass turns each text into the size of its shingle set, a 128-bit fingerprint of the full set and its band
   keys (``bands`` x ``band_rows`` bins of one permutation; an empty bin borrows from a bin drawn by a universal hash of
   its own number). Equal sets become one node.
2. Buckets with several nodes propose star pairs: every member with the least one, so pairs grow with members, not with
   their squares. Plausible pairs (see below) tie nodes into families.
3. Buckets whose nodes are not in one family by then are looked at again, by bins: one of up to ``bucket_rows`` nodes in
   one task, a larger one as all pairs of its blocks, spread over tasks. Only pairs that join families are written, so they grow
   with nodes. So any plausible pair that shares a bucket is in one family.
4. All pairs of a family are compared on full sets, in cells of many nodes: a text moves once for each block of its family, not
   for each pair, and pairs that are no links are written nowhere. No partner is dropped.

Nodes that share a bucket get a finer signature, one byte for each of ``fine_bins`` bins. Before texts are compared, a pair
must pass an exact bound (sets of sizes m <= n are never more similar than m / n) and agree in so many fine bins that a pair
at the wanted similarity fails with a probability of 3e-7 (five standard deviations), far below that of the bands. Links are
confirmed on full shingle sets. With the default 24 bands of 5 bins a pair at exactly 0.8 meets in no bucket with
probability 7e-5, and less above.

Texts and bands without a partner do not move: a bitmap of bounded size sieves them where they are read.

Hot groups (copies of one text, a bucket, a component, a star) are split over salts wherever rows meet by key.

Edge cases: null, empty and blank texts have an empty set and are their own component; fewer words than a
shingle make one shingle of the whole sequence; repeated rows share a set; a row with a null id takes part, and
a component is named by its smallest id that is not null; an empty table gives an empty result; only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenix.llm import common, groups


@dataclass(frozen=True)
class MinHashParams:
    """Words to a shingle, similarity in percent, banding, bins of the finer signature, nodes of a bucket that one task
    compares, nodes to a side of a cell of pairs. ``stars`` has no effect: larger buckets are compared block by block."""

    words: int = 5
    percent: int = 80
    bands: int = 24
    band_rows: int = 5
    fine_bins: int = 256
    bucket_rows: int = 2048
    stars: int = 16
    star_share: int = 2000

    @property
    def least_equal(self) -> int:
        """Equal fine bins below which a pair is not tested: five standard deviations under the wanted similarity."""
        n, j = self.fine_bins, self.percent / 100
        return max(0, int(n * j - 5 * (n * j * (1 - j)) ** 0.5))


#: Shingles to a side of a cell of pairs: what a task holds.
CELL_SHINGLES = 2_000_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each row."""
    s, e, first = common.word_bounds(raw, offsets)
    h = common.hash_spans(raw, s, e, True)
    n = max(0, len(h) - words + 1)
    g = np.zeros(n, np.uint64)
    for k in range(words):
        g += h[k : k + n] * _MIX[k % 8] + np.uint64(k // 8)
    g = common.mix64(g)
    out = []
    for lo, hi in zip(first.tolist(), first[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(g[lo : hi - words + 1]))
        elif hi > lo:
            out.append(common.mix64(np.array([int((h[lo:hi] * _MIX[: hi - lo]).sum()) ^ (hi - lo)], np.uint64)))
        else:
            out.append(h[:0])
    return out


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a full set."""
    a, b = common.mix64(shingles ^ _MIX[1]).sum(), common.mix64(shingles * _MIX[2] + _MIX[3]).sum()
    return np.array([a, b], np.uint64).tobytes()


def signature(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of bins for each non-empty set: the least hash there, or that of the bin it borrows from."""
    n = np.array([len(x) for x in sets], np.int64)
    allh = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    slot = ((allh >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    empty = np.uint64(2**64 - 1)
    sig = np.full(len(sets) * bins, empty)
    np.minimum.at(sig, np.repeat(np.arange(len(sets)), n) * bins + slot, common.mix64(allh))
    sig = sig.reshape(len(sets), bins)
    full = sig.copy()
    row, col = np.nonzero(sig == empty)
    attempt = 0
    while len(row):  # every set has a full bin, so this ends
        attempt += 1
        draw = common.mix64(col.astype(np.uint64) * _MIX[4] + np.uint64(attempt * int(_MIX[5]) & (1 << 64) - 1))
        got = sig[row, ((draw >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)]
        ok = got != empty
        full[row[ok], col[ok]] = got[ok]
        row, col = row[~ok], col[~ok]
    return full


def band_keys(full: np.ndarray, p: MinHashParams) -> np.ndarray:
    """One row of band keys for each signature."""
    keys = np.zeros((len(full), p.bands), np.uint64)
    for k in range(p.band_rows):
        keys = common.mix64(keys * _MIX[6] + full[:, k :: p.band_rows])
    return common.mix64(keys + np.arange(p.bands, dtype=np.uint64) * _MIX[7]).view(np.int64)


def sketch(documents: DataFrame, p: MinHashParams) -> DataFrame:
    """doc_id, n_shingles, node (fingerprint of the full set, null if empty), keys."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = common.text_bytes(batch.column(1))
            for i, j in common.blocks(off, 1 << 21):
                sets = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], p.words)
                keys = iter(band_keys(signature([x for x in sets if len(x)], p.bands * p.band_rows), p))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([fingerprint(x) if len(x) else None for x in sets], pa.binary()),
                        pa.array([next(keys) if len(x) else None for x in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "node", "keys"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, keys array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal width from a binary column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def near_in_size(m: np.ndarray, n: np.ndarray, p: MinHashParams) -> np.ndarray:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * np.minimum(m, n) >= p.percent * np.maximum(m, n)


def plausible(pairs: DataFrame, nodes: DataFrame, p: MinHashParams) -> DataFrame:
    """The ``pairs(a, b)`` whose sizes and bins allow a link; ``nodes(node, n, bins)``. ``pairs`` is a written table."""
    of = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bins").alias(f"bins_{k}"))
    both = groups.lookup(pairs, of("a"), ["a"]).join(of("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                m, n = (batch.column(k).to_numpy() for k in (2, 3))
                same = (_matrix(batch.column(4)) == _matrix(batch.column(5))).sum(1)
                yield batch.select([0, 1]).filter(pa.array(near_in_size(m, n, p) & (same >= p.least_equal)))

    return both.select("a", "b", "n_a", "n_b", "bins_a", "bins_b").mapInArrow(run, "a binary, b binary")


def confirmed(families: DataFrame, texts: DataFrame, p: MinHashParams) -> DataFrame:
    """``links(a, b)`` that join all nodes of a family which similar enough full sets connect; ``families(node, comp)`` and
    ``texts(node, text, n)`` are written tables.

    A family is one cell, a larger one is cut into blocks of about ``star_share`` nodes and ``CELL_SHINGLES`` shingles, and any two
    blocks make a cell. A text moves once for each block of its family, not for each pair. All pairs of a cell are compared.
    """
    sized = common.materialize(families.select("node", F.col("comp").alias("family")).join(texts.select("node", "n"), "node"), "sized")
    placed = groups.attach(sized, ["family"], [F.sum("n").alias("held")], at_least=2, row_salt=["node"])
    cuts = F.greatest(F.ceil(F.col("group_rows") / p.star_share), F.ceil(F.col("held") / CELL_SHINGLES)).cast("int")
    placed = placed.withColumn("cuts", cuts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, cuts - 1)")))
    cell = F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other")).alias("cell")
    placed = common.materialize(placed.select(cell, (F.col("own") > F.col("other")).alias("late"), "node"), "cells")
    wide = groups.sieve(texts.select("node", "text"), ["node"], placed).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, ([], [], [])

        def links(good: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            good = []
            sets: list[np.ndarray] = []
            raw, off = common.text_bytes(batch.column(3))
            for i, j in common.blocks(off, 1 << 21):
                sets += shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], p.words)
            for at, *row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets):
                if at != here:
                    good += linked(*held, p)
                    here, held = at, ([], [], [])
                for of, x in zip(held, row):
                    of.append(x)
            yield links(good)
        yield links(linked(*held, p))

    rows = placed.join(wide, "node").select("cell", "late", "node", "text")
    return rows.repartition("cell").sortWithinPartitions("cell", "late").mapInArrow(run, "a binary, b binary")


def linked(late: list[bool], names: list[bytes], sets: list[np.ndarray], p: MinHashParams) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links of a cell: between its two blocks, or all if it has none that is ``late``."""
    n, k = len(names), late.index(True) if True in late else len(names)
    whole = k == n
    shared = overlaps(sets[:k], sets[:k] if whole else sets[k:])
    size = np.array([len(x) for x in sets], np.int64)
    fresh = np.ones(n, bool)
    out = []
    for root in range(n):
        todo = [root] if fresh[root] else []
        fresh[root] = False
        while todo:
            u = todo.pop()
            both, start = (shared[u], 0 if whole else k) if u < k else (shared[:, u - k], 0)
            both, stop = both.astype(np.int64), start + len(both)
            near = fresh[start:stop] & (100 * both >= p.percent * (size[u] + size[start:stop] - both))
            got = (start + np.flatnonzero(near)).tolist()
            fresh[got] = False
            out += [(names[u], names[v]) for v in got]
            todo += got
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each set on the left with each on the right; ``left`` may be ``right``.

    Shingles of many pairs are counted by products of matrices, others pair by pair.
    """
    shape = len(left), len(right)
    counts = np.zeros(shape, np.int32)
    if not counts.size:
        return counts
    sides = []
    for sets in (left, right):
        h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(h, kind="stable")
        sides.append((h[order], row[order]))
    common_ones = np.intersect1d(*(h for h, _ in sides))
    of = [np.searchsorted(h, common_ones, side) for h, _ in sides for side in ("left", "right")]
    n_left, n_right = of[1] - of[0], of[3] - of[2]
    dense = n_left * n_right * 4096 > shape[0] * shape[1]
    many = np.flatnonzero(dense)
    width = max(1, 4_000_000 // (shape[0] + shape[1]))
    for q in range(0, len(many), width):
        part = many[q : q + width]
        m = []
        for (_, row), begin, n, rows in zip(sides, of[::2], (n_left, n_right), shape):
            m.append(np.zeros((rows, len(part)), np.float32))
            m[-1][row[_ranges(begin[part], n[part])], np.repeat(np.arange(len(part)), n[part])] = 1
        counts += (m[0] @ m[1].T).astype(np.int32)
    few = np.flatnonzero(~dense)
    pairs = np.cumsum(n_left[few] * n_right[few])
    for q in range(0, int(pairs[-1]) if len(pairs) else 0, 1_000_000):
        part = few[np.searchsorted(pairs, q, "right") if q else 0 : np.searchsorted(pairs, q + 1_000_000, "right")]
        i = _ranges(of[0][part], n_left[part])
        n = np.repeat(n_right[part], n_left[part])
        j = _ranges(np.repeat(of[2][part], n_left[part]), n)
        np.add.at(counts.reshape(-1), np.repeat(sides[0][1][i], n) * shape[1] + sides[1][1][j], 1)
    return counts


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin there, of these lengths."""
    return np.arange(int(n.sum())) + np.repeat(begin - np.cumsum(n) + n, n)


def components(edges: DataFrame) -> DataFrame:
    """node, comp of every node in ``edges(a, b)``: least labels spread over edges and jump along labels, to a fixpoint.

    Each round is written to the shared folder; the driver only learns whether anything changed.
    """
    both = common.materialize(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = common.materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"), F.lit(True).alias("moved")), "comp")
    while not state.where("moved").isEmpty():
        near = groups.lookup(both, state.select(F.col("node").alias("b"), "comp"), ["b"]).groupBy("a").agg(F.min("comp").alias("m"))
        spread = common.materialize(state.join(near, state["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("to")), "spread")
        jump = state.select(F.col("node").alias("to"), F.col("comp").alias("far"))
        new = groups.lookup(spread, jump, ["to"], row_salt=["node"]).select("node", F.least("to", "far").alias("comp"), (F.least("to", "far") != F.col("was")).alias("moved"))
        old, state = state, common.materialize(new, "comp")
        common.discard(old, spread)
    common.discard(both)
    return state


def candidates(at: DataFrame, nodes: DataFrame, p: MinHashParams) -> DataFrame:
    """``ties(a, b)``: plausible pairs that join those components of each bucket in ``at(key, node, comp, group_rows)`` that any
    plausible pairs of it join. ``nodes(node, n, bins, keys)``.

    A bucket of up to ``bucket_rows`` nodes is one unit, compared by bins within a task; a larger one is cut into blocks of half
    as many, and any two blocks make a unit. Every pair of a bucket meets in a unit, whatever the bucket's size.
    """
    blocks = F.when(F.col("group_rows") > p.bucket_rows, F.ceil(F.col("group_rows") / max(1, p.bucket_rows // 2))).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.expr("CASE WHEN blocks = 1 THEN array(0) ELSE filter(sequence(0, blocks - 1), x -> x <> own) END")
    units = at.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(others))
    home = F.col("other") == F.pmod(F.col("own") + 1, F.col("blocks"))  # where the pairs inside a block are compared
    units = units.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "key", "node", "comp", "own", home.alias("home"))
    rows = units.join(nodes.select("node", "n", "bins", "keys").hint("merge"), "node").select("unit", "key", "node", "comp", "own", "home", "n", "bins", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            unit = t["unit"].to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    yield between(t.slice(i, j - i), p)

        for batch in batches:  # sorted by unit: all units but the last one of a batch are whole
            if not len(batch):
                continue
            unit = batch.column(0).to_numpy()
            last = int(np.searchsorted(unit, unit[-1]))
            if last or (held and held[-1].column(0)[-1].as_py() != unit[0]):
                held.append(batch.slice(0, last))
                yield from edges()
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield from edges()

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a binary, b binary")


def equal_bins(sig: np.ndarray, by_bin: np.ndarray, i: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal bins of rows ``i[x]`` and ``y``; ``by_bin`` is ``sig`` turned. Where most pairs are asked, all are counted bin by bin."""
    if 8 * len(x) < len(i) * len(sig) or len(sig) < 64:
        return np.concatenate([(sig[i[x[q : q + 4096]]] == sig[y[q : q + 4096]]).sum(1) for q in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])
    total = np.zeros((len(i), len(sig)), np.uint16)
    for k in range(0, len(by_bin), 128):
        part = np.zeros(total.shape, np.uint8)
        for row in by_bin[k : k + 128]:
            part += (row[i][:, None] == row).view(np.uint8)
        total += part
    return total[x, y].astype(np.int64)


def between(unit: pa.Table, p: MinHashParams) -> pa.RecordBatch:
    """Plausible pairs between the components of a unit, fewer than its nodes: a pair within what earlier ones join is left
    out, and so is one that shares an earlier band as well, which is left to that band's bucket."""
    key = unit["key"][0].as_py()
    names = unit["node"].combine_chunks().cast(pa.binary())
    n = unit["n"].to_numpy()
    sig, comps = _matrix(unit["bins"].combine_chunks()), unit["comp"].combine_chunks().dictionary_encode()
    keys = unit["keys"].combine_chunks().flatten().to_numpy().reshape(len(n), -1)
    earlier = np.ascontiguousarray(keys[:, : next(iter(np.flatnonzero((keys == key).all(0))), 0)].T)
    by_bin = np.ascontiguousarray(sig.T)
    own, home = unit["own"].to_numpy(), unit["home"].to_numpy()
    label = comps.indices.to_numpy().astype(np.int64)
    largest = label == np.bincount(label).argmax()
    few = np.flatnonzero(~largest)
    at = np.arange(len(n))
    found = []
    for k in range(0, len(few), 32):
        i = few[k : k + 32]
        fit = (label[i][:, None] != label) & near_in_size(n[i][:, None], n, p) & (largest | (at > i[:, None]))
        fit &= home[i][:, None] | (own[i][:, None] != own)
        for band in earlier:
            fit &= band[i][:, None] != band
        x, y = np.nonzero(fit)
        ok = equal_bins(sig, by_bin, i, x, y) >= p.least_equal
        x, y = i[x[ok]], y[ok]
        while len(x):  # one pair joins two labels, the others between these two are done
            found.append((int(x[0]), int(y[0])))
            label[label == label[y[0]]] = label[x[0]]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
    return pa.RecordBatch.from_arrays([names.take(pa.array([f[k] for f in found], pa.int64())) for k in (0, 1)], ["a", "b"])


def near_duplicates(documents: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    sketched = common.materialize(sketch(documents, p), "sketch")
    some = sketched.where(F.col("node").isNotNull())
    nodes = common.materialize(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "nodes")
    rows = nodes.select("node", F.explode("keys").alias("key"))
    often = common.materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1"), "keys")
    met = common.materialize(groups.sieve(rows, ["key"], often), "bands")
    bucket = common.materialize(groups.attach(met, ["key"], [F.min("node").alias("first")], at_least=2, row_salt=["node"]), "buckets")
    common.discard(often, met)
    shared = common.materialize(bucket.select("node").distinct().join(nodes.select("node", "rep", "keys"), "node"), "shared")
    labels = common.materialize(shared.select("node", F.col("node").alias("comp")), "labels")
    if not bucket.isEmpty():
        some = groups.sieve(documents.select(F.col("doc_id").alias("rep"), "text"), ["rep"], shared)
        texts = some.select(F.col("rep").alias("doc_id"), "text").hint("merge").join(shared, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text", "keys")
        texts = common.materialize(own_texts(texts, p), "texts")
        first = common.materialize(bucket.where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "stars")
        ties = common.materialize(plausible(first, texts.select("node", "n", "bins"), p), "ties")  # the first centre is the least node
        families = relabelled(labels, ties)
        placed = common.materialize(bucket.where("group_rows > 2").select("key", "node").join(families, "node"), "placed")  # a bucket of two is settled by its star
        at = common.materialize(open_buckets(placed), "open")
        more = common.materialize(candidates(at, texts, p).distinct(), "ties")
        families = relabelled(families, more)
        links = common.materialize(confirmed(families, texts, p), "links")
        labels = components(links)
        common.discard(first, ties, placed, at, more, families, links, texts)
    named = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    named = common.materialize(named, "named")
    named = common.materialize(groups.attach(named, ["comp"], [F.min("rep").alias("component_id")], row_salt=["node"]).select("node", "component_id"), "components")
    out = groups.lookup(sketched.select("doc_id", "n_shingles", "node"), named, ["node"], "left", row_salt=["doc_id", "n_shingles"])
    comp = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    common.discard(nodes, bucket, shared, labels)
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def open_buckets(at: DataFrame) -> DataFrame:
    """The rows (key, node, comp, group_rows) of buckets that hold more than one component."""
    both = groups.attach(at.select("key", "node", "comp"), ["key"], [F.min("comp").alias("lo"), F.max("comp").alias("hi")], at_least=2, row_salt=["node"])
    return both.where("lo <> hi").select("key", "node", "comp", "group_rows")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, comp)`` after more links: only components that a link joins are solved again."""
    ends = links.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    joined = components(ends)
    moved = joined.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    new = common.materialize(groups.lookup(labels, moved, ["comp"], "left", row_salt=["node"]).select("node", F.coalesce("to", "comp").alias("comp")), "labels")
    common.discard(labels, joined)
    return new


def own_texts(texts: DataFrame, p: MinHashParams) -> DataFrame:
    """node, text, keys, n (size of its set), bins (a byte of each fine bin): rows whose text has the set that ``node`` stands for,
    one per node (an id that several rows share fetches them all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = common.text_bytes(batch.column(1))
            mine: list[bool] = []
            sizes: list[int] = []
            bins: list[bytes] = []
            for i, j in common.blocks(off, 1 << 21):
                sets = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], p.words)
                own = [bool(len(x)) and fingerprint(x) == node for x, node in zip(sets, batch.column(0).slice(i, j - i).to_pylist())]
                sets = [x for x, ok in zip(sets, own) if ok]
                mine += own
                sizes += [len(x) for x in sets]
                bins += [x.tobytes() for x in (signature(sets, p.fine_bins) >> np.uint64(56)).astype(np.uint8)]
            node, text, keys = batch.filter(pa.array(mine, pa.bool_())).columns
            yield pa.RecordBatch.from_arrays([node, text, keys, pa.array(sizes, pa.int64()), pa.array(bins, pa.binary())], ["node", "text", "keys", "n", "bins"])

    return texts.mapInArrow(run, "node binary, text string, keys array<long>, n long, bins binary").dropDuplicates(["node"])


def keep_first(documents: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """One document of each group, all columns; of repeated rows (equal id and text) one. A column may have any name."""
    name = common.unused_name(documents, "kept_doc_id")
    kept = near_duplicates(documents, p).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return common.one_of_each(documents.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi"), documents, F.coalesce("text", F.lit("")))
