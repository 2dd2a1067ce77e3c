"""The change feed as a stream: offsets, liveness above a floor, late arrivals, and caches with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream of changes."""
    return spark.readStream.schema(schema).parquet(folder)


def additions(feed: DataFrame, since: int) -> DataFrame:
    return feed.filter(F.col("history_id") > since)


def liveness(feed: DataFrame, floors: DataFrame) -> DataFrame:
    """thread_id, event_type, n of events above each thread's floor (floors: thread_id, floor). Works on streams as well."""
    return feed.join(floors, "thread_id").filter(F.col("history_id") > F.col("floor")).groupBy("thread_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def windows(feed: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events in tumbling windows, with a watermark (feed: ts, event_type, value)."""
    return feed.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def once(feed: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, as long as its repetitions come within the watermark."""
    return feed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["history_id"])


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, as a table in memory; for tests and small answers."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def expired(entries: DataFrame, now_us: int, ttl_us: int) -> DataFrame:
    """Cache entries (key, written_us) whose time is over."""
    return entries.filter(F.lit(now_us) - F.col("written_us") >= ttl_us)


def rebaseline(since: int, feed: DataFrame) -> bool:
    """Whether the feed no longer reaches back to an offset, so that silence says nothing about change."""
    oldest = feed.agg(F.min("history_id")).first()[0]
    return oldest is not None and since < oldest - 1
