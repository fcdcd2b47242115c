"""Incremental ingestion of feed files: exactly once into a table, late repeats dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.protocol import Protocol
from tidemark.sources.news import FEED, feed_items


def read_feed_stream(spark: SparkSession, folder: str, protocol: Protocol = Protocol(), lateness: str = "3 days") -> DataFrame:
    """Headlines of new files in ``folder``; repeats within the watermark drop out, and the state
    keeps no key longer than that."""
    items = spark.readStream.schema(FEED).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return feed_items(items, protocol).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["ticker", "ts", "headline"])


def ingest_feed(spark: SparkSession, folder: str, table: str, checkpoint: str, protocol: Protocol = Protocol()) -> StreamingQuery:
    """Append what is new to Parquet and stop; run again, it goes on from the checkpoint."""
    rows = read_feed_stream(spark, folder, protocol)
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
