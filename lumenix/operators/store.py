"""The derived-object store as tables: immutable objects, manifests, reuse, drift, merge, collection."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenix.functions import identity

OBJECTS = "object_key string, content_hash string, len bigint, tier string"
TIERS = {"A": "bit-identical on rebuild", "B": "the producer's bytes are the truth", "C": "written by a model"}
FORMATS, HASH = (1, 2), "sha256"


class KeyCollision(ValueError):
    """One key, two contents."""


class Tampered(ValueError):
    """Stored bytes differ from their recorded hash."""


# -- objects


def as_objects(df: DataFrame, key: Column, payload: Column, tier: str = "A") -> DataFrame:
    """object_key, content_hash, len, tier, payload."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}")
    return df.select(key.alias("object_key"), identity.content_hash(payload).alias("content_hash"), F.octet_length(payload).cast("bigint").alias("len"), F.lit(tier).alias("tier"), payload.alias("payload"))


def collisions(objects: DataFrame) -> DataFrame:
    """Keys with more than one content, both hashes."""
    return objects.groupBy("object_key").agg(F.min("content_hash").alias("ours"), F.max("content_hash").alias("theirs")).where("ours <> theirs")


def _refuse_collisions(objects: DataFrame) -> None:
    if bad := collisions(objects.select("object_key", "content_hash")).limit(5).collect():
        raise KeyCollision(f"same key, other bytes: {[r['object_key'] for r in bad]}")


def put(store: str, fresh: DataFrame) -> int:
    """Append the objects that are not there yet; equal ones are left alone, a key with other bytes is an error.

    What is there and what comes twice is found by keys alone; payloads move only where there is such a key.
    """
    spark = fresh.sparkSession
    have = read(spark, store)
    if have is not None:
        met = have.select("object_key", "content_hash").join(fresh.select("object_key"), "object_key", "left_semi")
        _refuse_collisions(fresh.select("object_key", "content_hash").unionByName(met))
        if not met.isEmpty():
            fresh = fresh.join(have.select("object_key"), "object_key", "left_anti")
    else:
        _refuse_collisions(fresh)
    keys = fresh.groupBy("object_key").agg(F.count(F.lit(1)).alias("times"))
    n, most = keys.agg(F.count(F.lit(1)), F.max("times")).first()
    if n:
        (fresh.dropDuplicates(["object_key"]) if most > 1 else fresh).write.mode("append").option("compression", "zstd").parquet(store)
    return n


def read(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store)
    except Exception as e:  # no such folder yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def verify(objects: DataFrame, manifest_objects: DataFrame) -> None:
    """Length first, then content, of every object that the manifest names."""
    m = manifest_objects.select("object_key", F.col("content_hash").alias("want_hash"), F.col("len").alias("want_len"))
    found = objects.select("object_key", F.octet_length("payload").alias("len"), identity.content_hash(F.col("payload")).alias("hash"))  # payloads stay where they are
    bad = found.join(m, "object_key").where((F.col("len") != F.col("want_len")) | (F.col("hash") != F.col("want_hash")))
    if rows := bad.select("object_key").limit(5).collect():
        raise Tampered(f"stored bytes differ from the manifest: {[r[0] for r in rows]}")


def reuse_plan(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """``candidates(object_key, ...)`` with ``action``: reuse what is known by key, compute the rest."""
    k = known.select(F.col("object_key").alias("known_key")).distinct()
    return candidates.join(k, F.col("object_key") == F.col("known_key"), "left").withColumn("action", F.when(F.col("known_key").isNull(), "compute").otherwise("reuse")).drop("known_key")


# -- manifests


@dataclass
class Manifest:
    """objects; dimensions(name, identity, levels); roots(resource, entry); clusters(dimension, keys)."""

    config_fingerprint: str
    objects: DataFrame
    dimensions: DataFrame
    roots: DataFrame
    clusters: DataFrame
    format_version: int = 2
    hash_algo: str = HASH
    provenance: dict = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {"objects": self.objects, "dimensions": self.dimensions, "roots": self.roots, "clusters": self.clusters}

    def digest(self) -> str:
        """Of all rows in order, without provenance: equal for equal content."""
        parts = [self.config_fingerprint]
        for name, df in self.tables().items():
            row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
            # Order-free: row digests add up modulo 2^60 in four lanes, in one pass over any number of rows.
            lanes = [F.sum(F.conv(F.substring(row, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
            r = df.agg(F.count(F.lit(1)).alias("n"), *lanes).first()
            parts.append(f"{name}:{r['n']}:" + ":".join(str(r[f"s{i}"] or 0) for i in range(4)))
        return identity.fingerprint(parts)

    def same_content(self, other: "Manifest") -> bool:
        return self.digest() == other.digest()


def save_manifest(m: Manifest, path: str) -> bool:
    """Write unless what is there has the same content; returns whether it wrote."""
    spark = m.objects.sparkSession
    head = f"{path}/head.json"
    digest = m.digest()
    if os.path.exists(head) and json.load(open(head)).get("digest") == digest:
        return False
    version = identity.fingerprint([digest, os.urandom(8).hex()])[:16]
    for name, df in m.tables().items():
        df.write.json(f"{path}/{version}/{name}")
    body = {"version": version, "digest": digest, "format_version": m.format_version, "hash_algo": m.hash_algo, "config_fingerprint": m.config_fingerprint, "provenance": m.provenance}
    os.makedirs(path, exist_ok=True)
    with open(head + ".part", "w") as f:
        json.dump(body, f, sort_keys=True)
    os.replace(head + ".part", head)
    del spark
    return True


SCHEMAS = {
    "objects": OBJECTS,
    "dimensions": "name string, identity string, levels array<int>",
    "roots": "resource string, entry string",
    "clusters": "dimension string, keys array<string>",
}


def manifest_digest(path: str) -> str:
    """The recorded digest of the manifest in a folder; empty without one."""
    head = f"{path}/head.json"
    return json.load(open(head))["digest"] if os.path.exists(head) else ""


def load_manifest(spark: SparkSession, path: str) -> Manifest:
    raw = open(f"{path}/head.json").read()
    if any(line.startswith(("<<<<<<<", ">>>>>>>")) for line in raw.split("\n")):
        raise ValueError("the manifest holds marks of an unfinished merge")
    head = json.loads(raw)
    if head["format_version"] not in FORMATS:
        raise ValueError(f"format {head['format_version']} is not known")
    if head["hash_algo"] != HASH:
        raise ValueError(f"hash {head['hash_algo']!r} is not known")
    t = {n: spark.read.schema(s).option("mode", "FAILFAST").json(f"{path}/{head['version']}/{n}") for n, s in SCHEMAS.items()}
    _refuse_collisions(t["objects"])
    return Manifest(head["config_fingerprint"], **t, format_version=head["format_version"], provenance=head["provenance"])


def named_keys(m: Manifest) -> DataFrame:
    """Every object key that roots (a JSON list each, of keys or of dimensions with their keys) and cluster trees refer to."""
    plain, keyed = F.from_json("entry", "array<string>"), F.from_json("entry", "array<struct<dimension:string,object_key:string>>")
    of_roots = m.roots.select(F.explode(F.when(F.col("entry").startswith("[{"), keyed["object_key"]).otherwise(plain)).alias("object_key"))
    return of_roots.unionByName(m.clusters.select(F.explode("keys").alias("object_key"))).distinct()


# -- three-way merge


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, outcome of one table merged by key: ``take`` (value may be null: deleted) or ``conflict``.

    Equal on both sides: taken. Changed on one side only: that side. Else a conflict, with our value.
    """
    b, o, t = (df.select(F.col(key), F.col(value).alias(n), F.lit(True).alias(f"has_{n}")) for df, n in ((base, "b"), (ours, "o"), (theirs, "t")))
    j = o.join(t, key, "full").join(b, key, "full")
    both = F.col("o").eqNullSafe(F.col("t")) & F.col("has_o").eqNullSafe(F.col("has_t"))
    ours_same = F.col("o").eqNullSafe(F.col("b")) & F.col("has_o").eqNullSafe(F.col("has_b"))
    theirs_same = F.col("t").eqNullSafe(F.col("b")) & F.col("has_t").eqNullSafe(F.col("has_b"))
    from_theirs = ~both & ours_same
    outcome = F.when(both | ours_same | theirs_same, "take").otherwise("conflict")
    return j.select(
        key,
        F.when(from_theirs, F.col("t")).otherwise(F.col("o")).alias(value),
        F.coalesce(F.when(from_theirs, F.col("has_t")).otherwise(F.col("has_o")), F.lit(False)).alias("present"),
        outcome.alias("outcome"),
    )


@dataclass
class Merged:
    manifest: Manifest
    notes: list[str]
    stale: list[str]


class MergeConflict(ValueError):
    def __init__(self, conflicts: list[tuple[str, str]]):
        super().__init__(f"conflicts: {conflicts}")
        self.conflicts = conflicts


def merge(base: Manifest | None, ours: Manifest, theirs: Manifest) -> Merged:
    """Dimensions, roots and trees three ways, objects as a union; all conflicts are reported together.

    A resource rebuilt on both sides keeps our entry and is listed as stale. Trees rebuilt on both sides are dropped
    (their objects stay, for reuse) and the dimension is back to level 0. Objects no merged root or tree names go.
    """
    spark = ours.objects.sparkSession
    empty = Manifest("", *[spark.createDataFrame([], SCHEMAS[n]) for n in ("objects", "dimensions", "roots", "clusters")])
    b = base or empty
    conflicts: list[tuple[str, str]] = []
    if ours.hash_algo != theirs.hash_algo:
        conflicts.append(("format", ours.hash_algo))
    fps = (b.config_fingerprint if base else None, ours.config_fingerprint, theirs.config_fingerprint)
    fp = fps[1] if fps[1] == fps[2] or fps[2] == fps[0] else fps[2] if fps[1] == fps[0] else None
    if fp is None:
        conflicts.append(("config_fingerprint", f"{fps[1]} / {fps[2]}"))
    whole = lambda df: df.withColumn("value", F.to_json(F.struct("identity", "levels")))
    dims = three_way(whole(b.dimensions), whole(ours.dimensions), whole(theirs.dimensions), "name", "value").persist()
    conflicts += [("dimension", r["name"]) for r in dims.where("outcome = 'conflict'").select("name").collect()]
    union = ours.objects.unionByName(theirs.objects)
    conflicts += [("object", r["object_key"]) for r in collisions(union).limit(1000).collect()]
    roots = three_way(b.roots, ours.roots, theirs.roots, "resource", "entry").persist()
    trees = three_way(b.clusters, ours.clusters, theirs.clusters, "dimension", "keys").persist()
    if conflicts:
        raise MergeConflict(conflicts)
    stale = [r[0] for r in roots.where("outcome = 'conflict'").select("resource").orderBy("resource").collect()]
    dropped = [r[0] for r in trees.where("outcome = 'conflict'").select("dimension").orderBy("dimension").collect()]
    levels = F.when(F.col("name").isin(dropped), F.array(F.lit(0))).otherwise(F.col("v.levels"))
    dimensions = dims.where("present").withColumn("v", F.from_json("value", "identity string, levels array<int>")).select("name", F.col("v.identity").alias("identity"), levels.alias("levels"))
    kept = Manifest(
        fp or "",
        union.dropDuplicates(["object_key"]),
        dimensions,
        roots.where("present").select("resource", "entry"),
        trees.where("present and outcome = 'take'").select("dimension", "keys"),
        format_version=max(ours.format_version, theirs.format_version),
    )
    of_dropped = ours.clusters.unionByName(theirs.clusters).where(F.col("dimension").isin(dropped)).select(F.explode("keys").alias("object_key"))
    kept.objects = kept.objects.join(named_keys(kept).unionByName(of_dropped).distinct(), "object_key", "left_semi")
    newer = (theirs.format_version, theirs.provenance.get("generated_at", 0)) > (ours.format_version, ours.provenance.get("generated_at", 0))
    kept.provenance = dict((theirs if newer else ours).provenance)
    return Merged(kept, [f"clusters of {d!r} were dropped: both sides rebuilt them; the next build makes them anew" for d in dropped], stale)


# -- drift


def drift(resources: DataFrame, snapshot: DataFrame) -> DataFrame:
    """resource, state: added, removed, changed or same; an unknown size or time counts as changed."""
    r = resources.select("resource", F.col("size").alias("n"), F.col("mtime_ns").alias("t"), F.lit(True).alias("now"))
    s = snapshot.select("resource", F.col("size").alias("was_n"), F.col("mtime_ns").alias("was_t"), F.lit(True).alias("then"))
    same = (F.col("n") == F.col("was_n")) & (F.col("t") == F.col("was_t"))
    state = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(same, "same").otherwise("changed")
    return r.join(s, "resource", "full").select("resource", state.alias("state"))


@dataclass(frozen=True)
class StaleReport:
    added: int
    removed: int
    changed: int
    config_changed: bool
    index_replaced: bool

    @property
    def fresh(self) -> bool:
        return not (self.added or self.removed or self.changed or self.config_changed or self.index_replaced)


def stale_report(resources: DataFrame, snapshot: DataFrame, config: tuple[str, str], manifest: tuple[str, str]) -> StaleReport:
    """Counts of drift; ``config`` and ``manifest`` are (recorded, current) fingerprints."""
    n = {r["state"]: r["count"] for r in drift(resources, snapshot).groupBy("state").count().collect()}
    return StaleReport(n.get("added", 0), n.get("removed", 0), n.get("changed", 0), config[0] != config[1], manifest[0] != manifest[1])


class Degraded(Enum):
    """What to do when a configured stage cannot run."""

    ABORT = "abort"
    ALLOW = "allow"
    ASK = "ask"


def decide(policy: Degraded, missing: list[str], ask=None) -> list[str]:  # type: ignore[no-untyped-def]
    """The dimensions that are left out; raises if the policy (or whoever is asked) says no. Such a build records no snapshot."""
    if not missing or policy is Degraded.ALLOW or (policy is Degraded.ASK and ask is not None and ask(missing)):
        return sorted(missing)
    raise RuntimeError(f"these dimensions cannot be built here: {sorted(missing)}")


# -- collection


def unreachable(objects: DataFrame, manifests: list[Manifest]) -> DataFrame:
    """Stored objects that no manifest lists."""
    if not manifests:
        raise ValueError("without a manifest nothing is known to be in use")
    live = manifests[0].objects.select("object_key")
    for m in manifests[1:]:
        live = live.unionByName(m.objects.select("object_key"))
    return objects.join(live.distinct(), "object_key", "left_anti")


def gc_report(objects: DataFrame, manifests: list[Manifest]) -> DataFrame:
    """By tier: objects and bytes that could go."""
    return unreachable(objects, manifests).groupBy("tier").agg(F.count(F.lit(1)).alias("objects"), F.sum("len").alias("bytes"))


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def prune(store: str, manifests: list[Manifest]) -> int:
    """Rewrite the store without unreachable objects: beside it first, then both change places, the old one goes last, so
    that a failure at any point leaves a whole store under one of the two names."""
    spark = manifests[0].objects.sparkSession
    have = read(spark, store)
    if have is None:
        return 0
    gone = unreachable(have, manifests).select("object_key").persist()
    n = gone.count()
    if n:
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        side = spark._jvm.org.apache.hadoop.fs.Path(store.rstrip("/") + "-kept")
        have.join(gone, "object_key", "left_anti").write.mode("overwrite").parquet(side.toString())
        old = spark._jvm.org.apache.hadoop.fs.Path(store.rstrip("/") + "-old")
        fs.delete(old, True)
        if not (fs.rename(path, old) and fs.rename(side, path)):
            raise OSError(f"{store} could not be replaced; its objects are in {old} and {side}")
        fs.delete(old, True)
    gone.unpersist()
    return n


def brief(counts: dict) -> str:
    """``status`` in a few lines, for a prompt or a session's start."""
    built = ", ".join(f"{n} (levels {', '.join(map(str, sorted(x)))})" for n, x in sorted(counts["dimensions"].items())) or "none"
    lines = [f"{counts['resources']} resources, {counts['objects']} objects", f"dimensions: {built}"]
    if counts["not_built"]:
        lines.append(f"configured but not built: {', '.join(counts['not_built'])}")
    if counts["stale"] is not None:
        lines.append("the index is out of date" if counts["stale"] else "the index is up to date")
    return "\n".join([*lines, *(f"advice: {a}" for a in counts["advice"])])


def ledger(spark: SparkSession, path: str, m: Manifest) -> bool:
    """Append this manifest's fingerprints (configuration, dimensions, content digest) unless the last entry is equal.

    A line-per-entry file that is only appended to, so that two branches' entries merge as lines.
    """
    entry = {"config": m.config_fingerprint, "digest": m.digest(), "dimensions": {r["name"]: r["identity"] for r in m.dimensions.collect()}}
    line = json.dumps(entry, sort_keys=True)
    if os.path.exists(path) and (rows := open(path).read().splitlines()) and rows[-1] == line:
        return False
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a") as f:
        f.write(line + "\n")
    return True


def status(m: Manifest, configured: Mapping[str, bool], report: StaleReport | None = None) -> dict:
    """Counts and advice about an index: what a status line or a session brief is written from."""
    built = {r["name"]: list(r["levels"]) for r in m.dimensions.collect()}
    missing = sorted(n for n, on in configured.items() if on and n not in built)
    advice = []
    if missing:
        advice.append("build the missing dimensions")
    if report is not None and not report.fresh:
        advice.append("refresh: the corpus or the configuration has moved on")
    return {"resources": m.roots.count(), "objects": m.objects.count(), "dimensions": built, "not_built": missing, "stale": None if report is None else not report.fresh, "advice": advice}
