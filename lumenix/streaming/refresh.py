"""Incremental refresh: new files of a table folder trigger the same reuse plan as a batch build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenix.functions import identity
from lumenix.operators import store
from lumenix.operators.score import structural
from lumenix.operators.segment import windows


def index_objects(contents: DataFrame, lines: int, overlap: int, config_fingerprint: str) -> DataFrame:
    """One object per resource text: the windows' term lengths, keyed by what goes in. Equal texts share a key."""
    seg = structural(windows(contents.select(F.lit("x").alias("origin"), identity.content_hash(F.col("text")).alias("resource"), "text").dropDuplicates(["resource"]), lines, overlap))
    body = F.to_json(F.array_sort(F.collect_list(F.struct("start", "end", "len"))))
    per = seg.groupBy("resource").agg(body.alias("body"))
    return store.as_objects(per, identity.object_key(config_fingerprint, F.col("resource")), F.col("body"))


def refresh_stream(spark: SparkSession, source: str, schema: str, to_contents: Callable[[DataFrame], DataFrame], objects: str, checkpoint: str, config_fingerprint: str, lines: int = 40, overlap: int = 8) -> StreamingQuery:
    """A file stream whose micro-batches add the objects that the store lacks. Replayed batches change nothing, since
    objects are keyed by their input; so the sink is exactly-once without a transaction."""

    def each(batch: DataFrame, _: int) -> None:
        store.put(objects, index_objects(to_contents(batch), lines, overlap, config_fingerprint))

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per type and tumbling window of an event stream or table, behind a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
