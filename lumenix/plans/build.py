"""Building, refreshing and opening an index: the offline pipeline as Spark jobs over tables in one folder.

    objects/                 one immutable object per dimension and distinct input: the windows' records as JSON
    manifest/                what the index is: objects, dimensions, roots, clusters
    cache/VERSION/           tables made of the objects that the manifest names, one folder per build:
      segments/              origin, resource, seg_no, start, end, first_line, last_line, text
      records/               dimension=..., location, level, terms, len      (dimensions scored by terms)
      vectors/               dimension=..., location, level, vec             (dimensions scored by cosine)
      clusters/, edges/      dimension=...
    snapshot/, config.json   the state of the corpus; which cache belongs to which manifest

Only inputs without an object are cut, classified and embedded; all others are served from their objects. A cache that was
made for another manifest is not trusted: it is made again from the objects when the index is opened. A dimension's records
are a partition, so a query reads the dimensions it asks and no others.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenix.functions import identity
from lumenix.functions import text as tx
from lumenix.functions import vectors as vec
from lumenix.operators import classify, cluster, retrieve, store
from lumenix.operators import score as sc
from lumenix.operators.segment import windows
from lumenix.plans.config import Config, check_levels, default, parse
from lumenix.sources import files, scratch

BODY = "array<struct<start:bigint,end:bigint,level:int,terms:array<string>,vec:array<float>>>"


@dataclass
class Stages:
    """Implementations by name. Embedders turn terms into a vector; ``llm`` builds a chat classifier in the worker.

    A further classifier maps (windows, its dimensions) to rows of location, level, dimension and terms. ``segmenter`` cuts
    contents into windows; ``discover`` lists a folder's files; ``preprocess`` turns them into contents. ``scorers`` score a
    dimension's table for a query text, in place of the built-in ones.
    """

    embedders: dict[str, Callable[[list[str]], list[float]]] = field(default_factory=lambda: {"hash": lambda t: vec.hash_vector(t, 256).tolist()})
    llm: Callable[[], classify.ChatClassifier] | None = None
    classifiers: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = field(default_factory=dict)
    segmenter: Callable[[DataFrame, int, int], DataFrame] = windows
    discover: Callable[[SparkSession, str, int], DataFrame] = files.discover
    preprocess: Callable[[DataFrame, str], DataFrame] = files.contents
    scorers: dict[str, Callable[[DataFrame, str], DataFrame]] = field(default_factory=dict)
    progress: Callable[[str, str, int], None] = lambda step, name, n: None

    def missing(self, config: Config) -> list[str]:
        """Active dimensions with a stage that cannot run here."""
        known = {"structural", "declaration", "content", *self.classifiers} | ({"llm"} if self.llm else set())
        bad = lambda d: (d.classifier is not None and d.classifier.impl not in known) or (d.embedder is not None and d.embedder.impl not in self.embedders)
        return [n for n, d in config.active().items() if bad(d)]


@dataclass
class BuildStats:
    discovered: int = 0
    indexed: int = 0
    skipped: int = 0
    segments: int = 0
    written: int = 0
    reused: int = 0
    clusters: int = 0
    unlabeled: int = 0
    left_out: list[str] = field(default_factory=list)


def read_config(root: str) -> Config:
    path = os.path.join(root, files.INDEX_DIR, files.CONFIG)
    return parse(open(path, encoding="utf-8").read()) if os.path.exists(path) else default()


def _impl(d) -> str:  # type: ignore[no-untyped-def]
    return d.classifier.impl if d.classifier else "structural"


def _classified(segments: DataFrame, impl: str, names: list[str], stages: Stages, persist: bool) -> DataFrame:
    """Location, level, dimension, terms of several dimensions that share an implementation, in one call."""
    if impl == "llm":
        found = classify.describe(segments, names, stages.llm)
        words = sc.frequency_records(found, "dimension") if persist else sc.term_records(found.withColumn("terms", tx.terms(F.col("descriptor"))), "dimension")
        return words.select(*sc.PLACE, "level", "dimension", "terms")
    if impl in stages.classifiers:
        return stages.classifiers[impl](segments, names).select(*sc.PLACE, "level", "dimension", "terms")
    one = classify.declaration_terms(segments) if impl == "declaration" else sc.structural(segments)
    return one.select(*sc.PLACE, "level", F.explode(F.array(*map(F.lit, names))).alias("dimension"), "terms")


def _objects(spark: SparkSession, contents: DataFrame, out: str, config: Config, stages: Stages, active: dict) -> tuple[DataFrame, int, int]:
    """(origin, resource, dimension, object_key of every input, objects written, objects reused). What is stored is not made again."""
    inputs = contents.select("origin", "resource", identity.content_hash(F.col("text")).alias("input"))
    each = [F.struct(F.lit(n).alias("dimension"), F.lit(d.fingerprint()).alias("fp")) for n, d in active.items()]
    keyed = inputs.withColumn("d", F.explode(F.array(*each))).select("origin", "resource", F.col("d.dimension").alias("dimension"), identity.object_key(F.col("d.fp"), F.col("input"), F.lit(config.segmenter()), F.col("d.dimension")).alias("object_key"))
    keyed = scratch.materialize(keyed, "keyed")
    total = keyed.select("object_key").distinct().count()
    have = store.read(spark, f"{out}/objects")
    owed = keyed if have is None else keyed.join(have.select("object_key"), "object_key", "left_anti")
    owed = scratch.materialize(owed.dropDuplicates(["object_key"]), "owed")  # equal texts share an object: one of them is worked on
    written = 0
    for impl, names in classify.group_by_implementation({n: _impl(d) for n, d in active.items()}).items():
        # Dimensions that lack the same inputs are answered by one call; there are no more such sets than subsets of names.
        asked = owed.where(F.col("dimension").isin(names)).groupBy("origin", "resource").agg(F.array_sort(F.collect_set("dimension")).alias("names"))
        for (group,) in asked.select("names").distinct().orderBy("names").collect():
            group = list(group)
            texts = contents.join(asked.where(F.col("names") == F.array(*map(F.lit, group))).select("origin", "resource"), ["origin", "resource"], "left_semi")
            rows = _classified(stages.segmenter(texts, config.lines, config.overlap), impl, group, stages, active[group[0]].emits_descriptor)
            if impl == "llm":
                rows = scratch.materialize(rows, "answers")  # asked once, whatever reads them
            for name in group:
                d = active[name]
                part = rows.where(F.col("dimension") == name).drop("dimension")
                part = vec.embed_rows(part, "terms", "vec", stages.embedders[d.embedder.impl]) if d.emits_tensor else part.withColumn("vec", F.lit(None).cast("array<float>"))
                terms = F.col("terms") if d.emits_descriptor else F.lit(None).cast("array<string>")
                body = part.groupBy("origin", "resource").agg(F.to_json(F.array_sort(F.collect_list(F.struct("start", "end", "level", terms.alias("terms"), "vec")))).alias("body"))
                mine = owed.where(F.col("dimension") == name).join(asked.where(F.array_contains("names", name) & (F.size("names") == len(group))), ["origin", "resource"]).where(F.col("names") == F.array(*map(F.lit, group)))
                made = mine.join(body, ["origin", "resource"], "left").select("object_key", F.coalesce("body", F.lit("[]")).alias("body"))
                fresh = scratch.materialize(store.as_objects(made, F.col("object_key"), F.col("body"), "C" if impl == "llm" else "B" if d.emits_tensor else "A"), "objects")
                n = store.put(f"{out}/objects", fresh)
                written += n
                stages.progress("objects", name, n)
                scratch.discard(fresh)
            if impl == "llm":
                scratch.discard(rows)
    scratch.discard(owed)
    return keyed, written, total - written


def _cache(spark: SparkSession, out: str, keyed: DataFrame, version: str, active: dict) -> None:
    """records/ and vectors/ of level 0, from stored objects alone; ``keyed`` names each resource's object."""
    have = store.read(spark, f"{out}/objects")
    for name, tensor, descriptor in active:
        own = keyed.where(F.col("dimension") == name).join(have.select("object_key", "payload"), "object_key")
        rows = own.select("origin", "resource", F.explode(F.from_json("payload", BODY)).alias("r")).select("origin", "resource", "r.*")
        if descriptor:
            sc.term_records(rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/cache/{version}/records/dimension={name}")
        if tensor:
            rows.select(*sc.PLACE, "level", "vec").write.mode("overwrite").parquet(f"{out}/cache/{version}/vectors/dimension={name}")


def build(spark: SparkSession, contents: DataFrame, out: str, config: Config, stages: Stages | None = None, policy: store.Degraded = store.Degraded.ABORT, snapshot: DataFrame | None = None) -> BuildStats:
    """Write all tables of an index over ``contents(origin, resource, text)``; stored objects are reused, not made again.

    Stored objects are checked against the last manifest first; the new cache counts once ``config.json`` names it.
    """
    stages = stages or Stages()
    stats = BuildStats(left_out=store.decide(policy, stages.missing(config)))
    active = {n: d for n, d in config.active().items() if n not in stats.left_out}
    old = _head(out)
    if old and (have := store.read(spark, f"{out}/objects")) is not None:
        store.verify(have, store.load_manifest(spark, f"{out}/manifest").objects)
    version = uuid.uuid4().hex[:16]
    seg_path = f"{out}/cache/{version}/segments"
    stages.segmenter(contents, config.lines, config.overlap).write.option("compression", "zstd").parquet(seg_path)
    stats.segments = spark.read.parquet(seg_path).count()
    stages.progress("segments", "", stats.segments)
    identities, trees, roots = [], [], spark.createDataFrame([], store.SCHEMAS["roots"])
    objects = spark.createDataFrame([], store.SCHEMAS["objects"])
    if active:
        keyed, stats.written, stats.reused = _objects(spark, contents, out, config, stages, active)
        _cache(spark, out, keyed, version, [(n, d.emits_tensor, d.emits_descriptor) for n, d in active.items()])
        roots = keyed.groupBy(F.concat_ws(":", "origin", "resource").alias("resource")).agg(F.to_json(F.array_sort(F.collect_set(F.struct("dimension", "object_key")))).alias("entry"))
        objects = store.read(spark, f"{out}/objects").select("object_key", "content_hash", "len", "tier")
    for name, d in active.items():
        levels = [0]
        if d.fabricator is not None:
            tree = _fabricate(spark, out, name, d, stages, version, old.get("cache"))
            levels, stats.clusters, stats.unlabeled = tree.levels, stats.clusters + tree.clusters.count(), stats.unlabeled + tree.unlabeled
            trees.append((name, [r[0] for r in tree.clusters.select("key").orderBy("key").collect()]))
            stages.progress("clusters", name, len(trees[-1][1]))
        identities.append((name, d.fingerprint(), levels))
    manifest = store.Manifest(config.fingerprint(), objects, spark.createDataFrame(identities, store.SCHEMAS["dimensions"]), roots, spark.createDataFrame(trees, store.SCHEMAS["clusters"]))
    manifest.objects = objects.join(store.named_keys(manifest), "object_key", "left_semi")
    store.save_manifest(manifest, f"{out}/manifest")
    if snapshot is not None and not stats.left_out:
        snapshot.write.mode("overwrite").parquet(f"{out}/snapshot")
    dims = {n: {"levels": d.levels, "tensor": d.emits_tensor, "descriptor": d.emits_descriptor, "embedder": d.embedder.impl if d.embedder else None, "impl": _impl(d), "fingerprint": d.fingerprint()} for n, d in active.items()}
    _write_head(out, {"fingerprint": config.fingerprint(), "manifest": store.manifest_digest(f"{out}/manifest"), "cache": version, "dimensions": dims})
    if old:
        store.delete(spark, f"{out}/cache/{old['cache']}")
    stats.indexed = contents.count()
    return stats


def _head(out: str) -> dict:
    path = f"{out}/config.json"
    return json.load(open(path)) if os.path.exists(path) else {}


def _write_head(out: str, head: dict) -> None:
    with open(f"{out}/config.json.part", "w") as f:
        json.dump(head, f)
    os.replace(f"{out}/config.json.part", f"{out}/config.json")


def restore(spark: SparkSession, out: str) -> str:
    """Make the cache again from the objects that the manifest names, and trust it from then on; returns its version.

    Clusters stay with the cache they were built in; if that is gone, a dimension is back to its segments.
    """
    head, m = _head(out), store.load_manifest(spark, f"{out}/manifest")
    version, had = uuid.uuid4().hex[:16], f"{out}/cache/{head['cache']}"
    entry = m.roots.select(F.split("resource", ":", 2).alias("p"), F.explode(F.from_json("entry", "array<struct<dimension:string,object_key:string>>")).alias("e"))
    keyed = entry.select(F.col("p")[0].alias("origin"), F.col("p")[1].alias("resource"), "e.dimension", "e.object_key")
    _cache(spark, out, keyed, version, [(n, d["tensor"], d["descriptor"]) for n, d in head["dimensions"].items()])
    for kind in ("segments", "clusters", "edges"):
        if os.path.exists(f"{had}/{kind}"):
            os.rename(f"{had}/{kind}", f"{out}/cache/{version}/{kind}")
    named = m.clusters.select("dimension", F.explode("keys").alias("key"))
    for name in head["dimensions"]:
        if os.path.exists(f"{out}/cache/{version}/clusters/dimension={name}"):
            kept = spark.read.parquet(f"{out}/cache/{version}/clusters/dimension={name}").join(named.where(F.col("dimension") == name), "key", "left_semi")
            _cluster_rows(kept).write.mode("append").parquet(f"{out}/cache/{version}/vectors/dimension={name}")
    _write_head(out, head | {"manifest": store.manifest_digest(f"{out}/manifest"), "cache": version})
    store.delete(spark, had)
    return version


def _cluster_rows(clusters: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return clusters.select(F.lit("clusters").alias("origin"), F.col("key").alias("resource"), zero.alias("start"), zero.alias("end"), "level", F.col("vec").cast("array<float>").alias("vec"))


def _fabricate(spark: SparkSession, out: str, name: str, d, stages: Stages, version: str, old: str | None) -> cluster.Tree:  # type: ignore[no-untyped-def]
    cache = f"{out}/cache/{version}"
    s = d.fabricator.settings
    p = cluster.TreeParams(**{k: s[k] for k in ("threshold", "min_cluster", "max_cluster", "max_levels", "min_remaining") if k in s})
    v = spark.read.parquet(f"{cache}/vectors/dimension={name}").where("level = 0")
    terms = spark.read.parquet(f"{cache}/records/dimension={name}").where("level = 0")
    key = identity.object_key(d.fingerprint(), F.col("origin"), F.col("resource"), F.col("start"), F.col("end"))
    pool = v.join(terms.select(*sc.PLACE, F.array_join("terms", " ").alias("descriptor")), sc.PLACE)
    pool = pool.select(key.alias("id"), "descriptor", "vec", F.struct("origin", "resource", "start").alias("no"), *sc.PLACE)
    embed = stages.embedders[d.embedder.impl]
    chat = stages.llm() if stages.llm and d.classifier.impl == "llm" else None

    def label(items: list[list[str]], level: int) -> list[str | None]:
        if chat is not None:
            return [x.get(name) for x in chat(items, [name], level)]
        return [" ".join(dict.fromkeys(" ".join(x).split())) or None for x in items]

    before = f"{out}/cache/{old}/clusters/dimension={name}"
    known = {r["key"]: r["label"] for r in spark.read.parquet(before).select("key", "label").collect()} if old and os.path.exists(before) else None
    tree = cluster.fabricate(pool.select("id", "descriptor", "vec", "no"), p, label, lambda t: embed(t.split()), d.fingerprint(), known)
    tree.clusters.write.mode("overwrite").parquet(f"{cache}/clusters/dimension={name}")
    tree.edges.join(pool.select(F.col("id").alias("child"), *sc.PLACE), "child", "left").write.mode("overwrite").parquet(f"{cache}/edges/dimension={name}")
    _cluster_rows(tree.clusters).write.mode("append").parquet(f"{cache}/vectors/dimension={name}")
    return tree


def open_index(spark: SparkSession, out: str, stages: Stages | None = None, config: Config | None = None, check: bool = True) -> retrieve.Index:
    """The index in a folder, its levels as built; a configuration that would hide levels is refused.

    Stored objects must have the bytes that the manifest names (``check``), else it is refused; a cache that was made for
    another manifest is made again.
    """
    stages = stages or Stages()
    m = store.load_manifest(spark, f"{out}/manifest")
    if check and (have := store.read(spark, f"{out}/objects")) is not None:
        store.verify(have, m.objects)
    head = _head(out)
    if head["manifest"] != store.manifest_digest(f"{out}/manifest") or not os.path.exists(f"{out}/cache/{head['cache']}"):
        restore(spark, out)
        head = _head(out)
    cache = f"{out}/cache/{head['cache']}"
    built = {r["name"]: tuple(r["levels"]) for r in m.dimensions.collect()}
    dims = {}
    for name, d in head["dimensions"].items():
        if config is not None and name in config.dimensions:
            check_levels(name, config.dimensions[name].search_levels(), built[name])
        scorer = stages.scorers.get(name)
        if d["tensor"]:
            embed = stages.embedders[d["embedder"]]
            dims[name] = retrieve.Dimension(vectors=spark.read.parquet(f"{cache}/vectors/dimension={name}"), encode=lambda t, e=embed: e(sc.query_terms(spark, t)), levels=built[name], fingerprint=d["fingerprint"], scorer=scorer)
        else:
            dims[name] = retrieve.Dimension(records=spark.read.parquet(f"{cache}/records/dimension={name}"), levels=built[name], fingerprint=d["fingerprint"], scorer=scorer)
    return retrieve.Index(dims, frozenset(config.dimensions) if config else frozenset())


def segments_of(spark: SparkSession, out: str) -> DataFrame:
    """The windows of the index in a folder."""
    return spark.read.parquet(f"{out}/cache/{_head(out)['cache']}/segments")


def index_folder(spark: SparkSession, root: str, out: str | None = None, config: Config | None = None, stages: Stages | None = None, policy: store.Degraded = store.Degraded.ABORT) -> BuildStats:
    """Discover, preprocess and build; the snapshot is taken before anything is read."""
    config, stages = config or read_config(root), stages or Stages()
    found = stages.discover(spark, root, config.max_bytes)
    snap = scratch.materialize(found.select("resource", "size", "mtime_ns"), "snapshot")
    contents = scratch.materialize(stages.preprocess(found, os.path.basename(os.path.realpath(root))), "contents")
    stats = build(spark, contents, out or os.path.join(root, files.INDEX_DIR), config, stages, policy, snap)
    stats.discovered = snap.count()
    stats.skipped = stats.discovered - stats.indexed
    scratch.discard(snap, contents)
    return stats


def staleness(spark: SparkSession, root: str, out: str | None = None) -> store.StaleReport:
    """What has moved since the build, from sizes and times alone."""
    out = out or os.path.join(root, files.INDEX_DIR)
    config = read_config(root)
    now = files.discover(spark, root, config.max_bytes).select("resource", "size", "mtime_ns")
    snap = f"{out}/snapshot"
    was = spark.read.parquet(snap) if os.path.exists(snap) else now.limit(0)
    head = _head(out)
    there = store.manifest_digest(f"{out}/manifest")
    return store.stale_report(now, was, (head.get("fingerprint", ""), config.fingerprint()), (head.get("manifest", ""), there))


def refresh(spark: SparkSession, root: str, out: str | None = None, stages: Stages | None = None) -> BuildStats | None:
    """Nothing if nothing moved; else a pass that reuses every unchanged object."""
    return None if staleness(spark, root, out).fresh else index_folder(spark, root, out, None, stages)
