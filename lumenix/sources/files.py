"""Files as a corpus: discovery with ignore rules, text preprocessing, index roots, JSONL."""

from __future__ import annotations

import os
import re
import unicodedata
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenix.functions import text as tx
from lumenix.sources import scratch
from lumenix.sources.tables import ensure_importable

INDEX_DIR = ".lumenix"
CONFIG = "config.toml"


def find_root(start: str) -> str | None:
    """The nearest folder upward that holds an index configuration."""
    here = Path(start).resolve()
    return next((str(p) for p in [here, *here.parents] if (p / INDEX_DIR / CONFIG).is_file()), None)


@F.arrow_udf(T.StringType())
def nfc(keys: pa.Array) -> pa.Array:
    """Texts of an Arrow batch are objects of Python only a few at a time."""
    one = lambda k: k if k is None or k.isascii() else unicodedata.normalize("NFC", k)
    parts = [pa.array([one(k) for k in keys.slice(lo, 64).to_pylist()], pa.string()) for lo in range(0, len(keys), 64)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def ignore_patterns(listed: DataFrame) -> list[tuple[str, bool, str, bool]]:
    """(folder, negated, pattern, folders only) of the listed tree's ignore files, outer ones first."""
    found = []
    files = listed.where((F.col("resource") == ".gitignore") | F.col("resource").endswith("/.gitignore")).select("path", "resource").collect()
    for path, resource in sorted(map(tuple, files), key=lambda x: x[1].split("/")):
        base = os.path.dirname(resource)
        for line in open(path, encoding="utf-8", errors="replace").read().splitlines():
            rule = line.rstrip() if not line.endswith("\\ ") else line
            if not rule or rule.startswith("#"):
                continue
            negated = rule.startswith("!")
            rule = rule[1:] if negated else rule.removeprefix("\\")
            found.append((base, negated, rule.rstrip("/"), rule.endswith("/")))
    return sorted(found, key=lambda x: x[0].split("/") if x[0] else [])


def _glob(rule: str) -> str:
    """A regular expression for one ignore pattern, relative to its folder."""
    anchored = "/" in rule
    out, i = "", 0
    rule = rule.lstrip("/")
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.+", i + 3
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 1 :]:
            j = rule.index("]", i + 1)
            out, i = out + re.sub(r"^\[!", "[^", rule[i : j + 1]), j + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out


def ignored(key: Column, patterns: list[tuple[str, bool, str, bool]]) -> Column:
    """Whether a key or a folder above it is ignored; the last rule that fits decides."""
    out = F.lit(False)
    for folder, negated, rule, only_folders in patterns:
        lead = re.escape(folder) + "/" if folder else ""
        out = F.when(key.rlike(f"^{lead}{_glob(rule)}{'/' if only_folders else '(?:/|$)'}"), F.lit(not negated)).otherwise(out)
    return out


def _entries(batches):  # type: ignore[no-untyped-def]
    """What the folders of a batch hold; links to folders are not followed, names that are not UTF-8 are left out."""
    for batch in batches:
        rows = []
        for folder in batch.column(0).to_pylist():
            try:
                inside = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            for e in inside:
                try:
                    e.path.encode("utf-8")
                    if e.is_dir():
                        if not e.is_symlink() and e.name not in (".git", INDEX_DIR):
                            rows.append((e.path, True, 0, 0))
                    else:
                        stat = os.stat(e.path)
                        rows.append((e.path, False, stat.st_size, stat.st_mtime_ns))
                except (UnicodeEncodeError, OSError):
                    continue
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["path", "folder", "size", "mtime_ns"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, resource, size, mtime_ns of all files under a root, hidden ones too; names that are not UTF-8 are left out.

    Spark's own file sources pass over names that begin with ``.`` or ``_``, so folders are listed by tasks here, one level
    of the tree after the other; no list of files reaches the driver.
    """
    ensure_importable(spark)
    base = os.path.realpath(root)
    folders = spark.createDataFrame([(base,)], "path string")
    found: DataFrame | None = None
    while True:
        level = scratch.materialize(folders.mapInArrow(_entries, "path string, folder boolean, size bigint, mtime_ns bigint"), "listing")
        files = level.where(~F.col("folder"))
        found = files if found is None else found.unionByName(files)
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            break
        folders = folders.repartition(spark.sparkContext.defaultParallelism)
    return found.select("path", nfc(F.substr("path", F.lit(len(base.rstrip("/")) + 2))).alias("resource"), "size", "mtime_ns")


def discover(spark: SparkSession, root: str, max_bytes: int = 4 << 20) -> DataFrame:
    """path, resource, size, mtime_ns of what is indexed: no ignored, empty, oversized or oddly named files."""
    every = listing(spark, root)
    found = every.where((F.col("size") > 0) & (F.col("size") <= max_bytes))
    return found.where(tx.safe_key(F.col("resource")) & ~ignored(F.col("resource"), ignore_patterns(every)))


def _read(batches):  # type: ignore[no-untyped-def]
    for batch in batches:
        for i in range(batch.num_rows):  # one file at a time: each is bounded, a batch of them is not
            try:
                with open(batch.column(0)[i].as_py(), "rb") as f:
                    body = f.read()
            except OSError:
                continue
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), pa.array([body], pa.binary())], ["resource", "content"])


def contents(files: DataFrame, origin: str) -> DataFrame:
    """origin, resource, text of discovered files, read where the task runs (the root is on a shared file system).

    Binary files and invalid UTF-8 are left out; a byte order mark stays; a file that has gone is skipped.
    """
    read = files.select("path", "resource").mapInArrow(_read, "resource string, content binary")
    return read.select(F.lit(origin).alias("origin"), "resource", tx.content_or_null(F.col("content")).alias("text")).where(F.col("text").isNotNull())


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; blank lines do not count, a bad one is named by number."""
    n = 0
    import json

    for n, line in enumerate(open(path, encoding="utf-8"), 1):  # noqa: B007
        if line.strip():
            try:
                json.loads(line)
            except ValueError as e:
                raise ValueError(f"{path}: line {n}: {e}") from e
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


QUERIES = "id string, text string, kind string, form string, facet string, absent_in array<string>"
QRELS = "query_id string, resource string, start_line int, end_line int, grade int, why string"


def golden(spark: SparkSession, queries: str, qrels: str) -> tuple[DataFrame, DataFrame]:
    """A golden set: optional fields default to empty; judgments keep their order in ``no``."""
    q = jsonl(spark, queries, QUERIES).fillna("", ["kind", "form", "facet"]).withColumn("absent_in", F.coalesce("absent_in", F.array().cast("array<string>")))
    return q, jsonl(spark, qrels, QRELS).withColumn("no", F.monotonically_increasing_id())

