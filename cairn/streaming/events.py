"""Streams: events in windows with late data, sessions, and deliveries merged into a keyed snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of landed Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windows(events: DataFrame, every: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of event-time windows; works on a stream and on a table alike."""
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap longer than this."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")


def merge_deliveries(previous: DataFrame, batch: DataFrame, read_sources: DataFrame, key: str, today: str) -> DataFrame:
    """The keyed snapshot after a batch: new rows in place of old ones; a key that its source, though read, no longer
    delivers stays with `missing_since`. For use on tables and in foreachBatch alike."""
    fresh = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "retrieved_at").alias("r")).select(key, "r.*").withColumn("missing_since", F.lit(None).cast("string"))
    old = previous.join(batch.select(key), key, "left_anti")
    gone = old.join(read_sources.select("source").distinct().withColumn("_read", F.lit(True)), "source", "left")
    kept = gone.withColumn("missing_since", F.when(F.coalesce("_read", F.lit(False)), F.coalesce("missing_since", F.lit(today))).otherwise(F.col("missing_since"))).drop("_read")
    return fresh.unionByName(kept)
