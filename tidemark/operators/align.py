"""Headlines to the first session they could have been traded on.

The as-of join (first cut-off strictly after a stamp) is an equi-join on the local date: a dense
table has, for every natural date, whether it is a session, its cut-off and the session after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import wall_time
from tidemark.operators.prices import neighbours
from tidemark.protocol import Protocol

PANEL = ["row_id", "ticker", "ts", "headline", "signal_date", "ret_next_excess", "liquidity_tercile", "y"]


def session_table(calendar: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """local_date, cutoff (wall time, null if no session), session_after: a row a natural date
    from the first to the last session."""
    bounds = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a IS NOT NULL")
    dense = bounds.select(F.explode(F.sequence("a", "b")).alias("local_date"))
    minutes = F.when(F.col("date").isin(*protocol.early_closes), protocol.early_cutoff.hour * 60 + protocol.early_cutoff.minute).otherwise(protocol.cutoff.hour * 60 + protocol.cutoff.minute)
    joined = dense.join(calendar.select("date"), dense["local_date"] == F.col("date"), "left")
    later = Window.orderBy("local_date").rowsBetween(1, Window.unboundedFollowing)
    cutoff = F.when(F.col("date").isNotNull(), F.col("local_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes))
    return joined.select("local_date", cutoff.alias("cutoff"), F.min("date").over(later).alias("session_after"))


def with_signal_date(news: DataFrame, calendar: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """``news`` with signal_date: the first session whose cut-off is strictly after ts, null beyond
    the calendar; what is older than the calendar goes to its first session."""
    first = calendar.agg(F.min("date")).first()[0]
    local = wall_time(F.col("ts").cast("timestamp"), protocol.zone)
    placed = news.withColumns({"_local": local, "local_date": local.cast("date")})
    joined = placed.join(F.broadcast(session_table(calendar, protocol)), "local_date", "left")
    found = F.when(F.col("local_date") < F.lit(first), F.lit(first)).when(F.col("_local") < F.col("cutoff"), F.col("local_date")).otherwise(F.col("session_after"))
    return joined.withColumn("signal_date", found.cast("date")).select(*news.columns, "signal_date")


def with_row_id(panel: DataFrame, day: str, *order: str) -> DataFrame:
    """Numbers 0, 1, ... by day and ``order``: a row number within each day and the days' offsets,
    so no task sees more than a day."""
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    offsets = panel.groupBy(day).count().select(day, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    n = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    return panel.withColumn("_n", n).join(F.broadcast(offsets), day).withColumn("row_id", (F.col("_o") + F.col("_n") - 1).cast("long")).drop("_o", "_n")


def numbered(rows: DataFrame) -> DataFrame:
    """A panel of ``aligned`` rows with row_id. Rows are read for the days' offsets and for their
    numbers, so large ones are best written before."""
    return with_row_id(rows, "signal_date", "ticker", "ts", "headline").select(*PANEL)


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", (F.col("ret_next_excess") > 0).cast("byte")).select(*PANEL[1:])


def aligned(news: DataFrame, returns: DataFrame, calendar: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """Headlines with the next-day excess return of the first session they can be traded on."""
    eligible = returns.where("eligible").select("ticker", F.col("date").alias("signal_date"), "ret_next_excess", "liquidity_tercile")
    dated = with_signal_date(news, calendar, protocol).where(F.col("signal_date").isNotNull())
    return _labelled(dated.join(eligible, ["ticker", "signal_date"]))


def aligned_same_day(news: DataFrame, returns: DataFrame, calendar: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """The leaky alignment, for comparison: a headline's own date with the return that ends on it."""
    ends = neighbours(calendar).select("date", F.col("next_session").alias("signal_date"))
    ending = returns.where("eligible").join(F.broadcast(ends), "date").where(F.col("signal_date").isNotNull()).select("ticker", "signal_date", "ret_next_excess", "liquidity_tercile")
    dated = news.withColumn("signal_date", wall_time(F.col("ts").cast("timestamp"), protocol.zone).cast("date"))
    return _labelled(dated.join(ending, ["ticker", "signal_date"]))


def build_panel(news: DataFrame, returns: DataFrame, calendar: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """``aligned`` rows, numbered."""
    return numbered(aligned(news, returns, calendar, protocol))


def build_panel_same_day(news: DataFrame, returns: DataFrame, calendar: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """``aligned_same_day`` rows, numbered."""
    return numbered(aligned_same_day(news, returns, calendar, protocol))
