"""Tables as corpora: resources with an origin, a key and a text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it through ``sys.path`` alone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, over all cores if its files fit a single split: one task would cut and tokenise all of it else. Larger tables
    are read in as many splits as they have, without a shuffle; results are the same."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    one = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= one else df


def _key(prefix: str, number: str):  # type: ignore[no-untyped-def]
    return F.concat(F.lit(prefix + "/"), F.lpad(F.col(number).cast("string"), 9, "0"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return spread(d.select(F.lit("docs").alias("origin"), _key("doc", "doc_id").alias("resource"), "text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages")
    return spread(d.select(F.lit("pages").alias("origin"), _key("page", "page_id").alias("resource"), F.col("html").alias("text")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resource per conversation: its turns in order, a line each."""
    d = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n")
    return d.groupBy("conv_id").agg(text.alias("text")).select(F.lit("chats").alias("origin"), _key("chat", "conv_id").alias("resource"), "text")


def label_roots(paths: list[str]) -> dict[str, str]:
    """Labels of additional roots: the folder's name, behind its parent's where two clash; equal places count once."""
    real = list(dict.fromkeys(os.path.realpath(p) for p in paths))
    names = [os.path.basename(p) or p for p in real]
    return {(n if names.count(n) == 1 else f"{os.path.basename(os.path.dirname(p))}/{n}"): p for n, p in zip(names, real)}


def federate(members: dict[str, DataFrame]) -> DataFrame:
    """Contents of several corpora under unique origins."""
    out: DataFrame | None = None
    for origin, df in members.items():
        part = df.withColumn("origin", F.lit(origin))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no members")
    return out
