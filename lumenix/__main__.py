"""Command line: ``python -m lumenix index|find|status|classify|gc ...``."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenix.functions import text as tx
from lumenix.operators import classify, retrieve, store
from lumenix.operators.segment import windows
from lumenix.plans import build
from lumenix.sources import files


def _session() -> SparkSession:
    return SparkSession.builder.appName("lumenix").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _find(spark: SparkSession, a: argparse.Namespace) -> None:
    query = dict(retrieve.parse_dimension(x) for x in a.dim)
    members = {}
    for label, root in build_roots(a.root).items():
        if a.update:
            build.refresh(spark, root)
        members[label] = build.open_index(spark, os.path.join(root, files.INDEX_DIR), config=build.read_config(root))
    index = next(iter(members.values())) if len(members) == 1 else retrieve.federation(members)
    hits = index.find_at(query, None, retrieve.parse_levels(a.level))
    shown = retrieve.regions(hits, a.per_file, a.limit)
    segs = None
    for label, root in build_roots(a.root).items():
        s = build.segments_of(spark, os.path.join(root, files.INDEX_DIR))
        segs = s if segs is None else segs.unionByName(s)
    lines = segs.select("resource", "start", "first_line", "last_line", tx.snippet(F.col("text"), F.col("first_line"), F.col("last_line"), a.lines).alias("snippet"))
    for r in shown.join(lines, ["resource", "start"], "left").orderBy("place").collect():
        more = f"  (more at {', '.join(map(str, r['more'][:3]))}{f' and {len(r["more"]) - 3} others' if len(r['more']) > 3 else ''})" if r["more"] else ""
        print(f"{r['score']:.4f}  {r['origin']}:{r['resource']}:{r['first_line'] or ''}  level {r['level']}, {r['segments']} windows{more}")
        if a.lines and r["snippet"]:
            print("    " + r["snippet"].replace("\n", "\n    "))


def build_roots(roots: list[str]) -> dict[str, str]:
    from lumenix.sources.tables import label_roots

    found = [files.find_root(r) or r for r in (roots or ["."])]
    return label_roots(found)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lumenix", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="write a configuration")
    c.add_argument("root", nargs="?", default=".")
    c = sub.add_parser("index", help="build or refresh")
    c.add_argument("root", nargs="?", default=".")
    c.add_argument("--degraded", choices=[x.value for x in store.Degraded], default="abort")
    c = sub.add_parser("find", help="search: DIM[:WEIGHT]=TEXT ...")
    c.add_argument("dim", nargs="+")
    c.add_argument("--root", action="append", default=[])
    c.add_argument("--level", default="all")
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--per-file", type=int, default=2)
    c.add_argument("--lines", type=int, default=12)
    c.add_argument("-u", "--update", action="store_true")
    c = sub.add_parser("status", help="what is built, what has moved")
    c.add_argument("root", nargs="?", default=".")
    c.add_argument("--brief", action="store_true")
    c = sub.add_parser("classify", help="what the declaration and term classifiers make of a file")
    c.add_argument("file")
    c = sub.add_parser("gc", help="objects that no manifest lists")
    c.add_argument("root", nargs="?", default=".")
    c.add_argument("--prune", action="store_true")
    a = p.parse_args(argv)
    if a.command == "init":
        path = os.path.join(a.root, files.INDEX_DIR, files.CONFIG)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if not os.path.exists(path):
            with open(path, "w") as f:
                f.write('version = 1\n\n[segmenter]\nlines = 40\noverlap = 8\n\n[dimensions.lexical.classifier]\nimpl = "structural"\n\n[dimensions.declaration.classifier]\nimpl = "declaration"\n')
        return 0
    spark = _session()
    if a.command == "index":
        print(json.dumps(vars(build.index_folder(spark, a.root, policy=store.Degraded(a.degraded)))))
    elif a.command == "find":
        _find(spark, a)
    elif a.command == "status":
        out = os.path.join(a.root, files.INDEX_DIR)
        config = build.read_config(a.root)
        counts = store.status(store.load_manifest(spark, f"{out}/manifest"), {n: d.enabled for n, d in config.dimensions.items()}, build.staleness(spark, a.root))
        print(store.brief(counts) if a.brief else json.dumps(counts))
    elif a.command == "classify":
        one = spark.createDataFrame([("x", a.file, open(a.file, encoding="utf-8").read())], "origin string, resource string, text string")
        seg = windows(one)
        for r in seg.select("first_line", classify.frequency_descriptor(tx.terms(F.col("text"))).alias("d")).orderBy("first_line").collect():
            print(f"{r[0]}: {r[1]}")
    elif a.command == "gc":
        out = os.path.join(a.root, files.INDEX_DIR)
        m = [store.load_manifest(spark, f"{out}/manifest")]
        if a.prune:
            print(store.prune(f"{out}/objects", m))
        else:
            store.gc_report(store.read(spark, f"{out}/objects").drop("payload"), m).show()
    done = 0
    return done


if __name__ == "__main__":
    raise SystemExit(main())
