"""Zones, lenient and strict parsing. Sessions run in UTC; a wall time is a timestamp_ntz."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = r"([+-]\d{2}:?\d{2}|Z)$"


def wall_time(ts: Column, zone: str) -> Column:
    """The wall time of an instant."""
    return F.from_utc_timestamp(ts, zone).cast("timestamp_ntz")


def instant(wall: Column, zone: str) -> Column:
    """The instant of a wall time: the later of two, null if the clock skips it."""
    early = F.to_utc_timestamp(wall.cast("timestamp"), zone)
    late = early + F.expr("INTERVAL 1 HOUR")
    back = lambda t: F.from_utc_timestamp(t, zone) == wall.cast("timestamp")
    return F.when(back(late), late).when(back(early), early)


def parse_offset_stamp(s: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with a UTC offset (with or without colon) or Z; null without."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ssXXX")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ssXX")))


def parse_compact_stamp(s: Column) -> Column:
    """``yyyyMMddTHHmmss`` as a wall time; anything else fails the query."""
    return F.to_timestamp(s, "yyyyMMdd'T'HHmmss").cast("timestamp_ntz")


def offset_of(s: Column) -> Column:
    found = F.regexp_extract(s, OFFSET, 1)
    return F.when(found != "", found)


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")
