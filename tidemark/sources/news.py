"""Headline files: CSV with offset stamps, and JSON feeds with nested ticker scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import instant, offset_of, parse_compact_stamp, parse_offset_stamp, stripped, wall_time
from tidemark.protocol import Protocol

FEED = "title string, time_published string, ticker_sentiment array<struct<ticker:string, relevance_score:string>>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings. Files are split among tasks unless a record goes over line ends,
    which a line with an odd number of quotes shows."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    broken = bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=broken)


def clean_news(raw: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """ticker (stripped, upper case), ts, headline (stripped), each combination once."""
    rows = raw.select(F.upper(stripped(F.col(protocol.ticker_col))).alias("ticker"), parse_offset_stamp(F.col(protocol.stamp_col)).alias("ts"), stripped(F.col(protocol.headline_col)).alias("headline"))
    return rows.where("ticker IS NOT NULL AND ts IS NOT NULL AND headline IS NOT NULL").dropDuplicates(["ticker", "ts", "headline"])


def load_news(raw: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """As ``clean_news``, but an error if fewer than 99 in 100 stamps carry an offset."""
    share = raw.agg(F.avg(parse_offset_stamp(F.col(protocol.stamp_col)).isNotNull().cast("int"))).first()[0]
    if share is None or share < 0.99:
        raise ValueError(f"{share} of the stamps carry a UTC offset; gate G1 fails")
    return clean_news(raw, protocol)


def midnight_share(raw: DataFrame, column: str) -> DataFrame:
    return raw.agg(F.avg(F.col(column).rlike(" 00:00:00").cast("int")).alias("midnight_share"))


def offset_counts(raw: DataFrame, column: str) -> DataFrame:
    return raw.select(offset_of(F.col(column)).alias("utc_offset")).where("utc_offset IS NOT NULL").groupBy("utc_offset").agg(F.count(F.lit(1)).alias("n"))


def clock_agreement(raw: DataFrame, column: str, protocol: Protocol = Protocol()) -> DataFrame:
    """Share of all stamps whose written wall time is the zone's at that instant; a stamp that
    can't be read counts against it."""
    s = F.col(column)
    written = F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return raw.agg(F.avg(F.coalesce(wall_time(parse_offset_stamp(s), protocol.zone) == written, F.lit(False)).cast("int")).alias("agreement"))


def offsets_follow_clock(raw: DataFrame, column: str, protocol: Protocol = Protocol()) -> tuple[bool, float]:
    found = {r.utc_offset for r in offset_counts(raw, column).collect()}  # a few strings
    share = clock_agreement(raw, column, protocol).first()[0] or 0.0
    return bool(found) and found <= {"+00:00", "+0000", "Z"} or share >= protocol.min_clock_agreement, share


def feed_items(items: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """A row for each ticker of an item that is relevant enough."""
    flat = items.select("title", "time_published", F.inline("ticker_sentiment"))
    kept = flat.where(F.col("relevance_score").cast("double") >= protocol.min_relevance)
    ts = instant(parse_compact_stamp(F.col("time_published")), protocol.feed_zone)
    return kept.select("ticker", ts.alias("ts"), F.col("title").alias("headline")).where("ts IS NOT NULL")


def load_feed(spark: SparkSession, folder: str, protocol: Protocol = Protocol()) -> DataFrame:
    """The folder's JSON arrays. A repeated autumn hour is its later instant, a skipped spring one
    is dropped; each (ticker, ts, headline) once. An empty folder gives no rows."""
    items = spark.read.schema(FEED).json(folder, multiLine=True, pathGlobFilter="*.json")
    return feed_items(items, protocol).dropDuplicates(["ticker", "ts", "headline"])
