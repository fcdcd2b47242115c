from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.protocol import Protocol

DAYS = [date(2019, 3, 7), date(2019, 3, 8), date(2019, 3, 11), date(2019, 3, 12)]


def calendar(spark, days=DAYS):
    return spark.createDataFrame([(d,) for d in days], "date date")


def utc(wall, hours):
    return datetime.fromisoformat(wall) + timedelta(hours=hours)


@pytest.mark.parametrize(
    ("wall", "hours", "want"),
    [
        ("2019-03-08 15:49:59", 5, date(2019, 3, 8)),
        ("2019-03-08 15:50:00", 5, date(2019, 3, 11)),
        ("2019-03-08 16:30:00", 5, date(2019, 3, 11)),
        ("2019-03-11 15:49:00", 4, date(2019, 3, 11)),
        ("2019-03-11 15:51:00", 4, date(2019, 3, 12)),
        ("2019-03-12 15:50:00", 4, None),
        ("2018-01-01 09:00:00", 5, DAYS[0]),
        ("2019-04-01 09:00:00", 4, None),
    ],
)
def test_cutoff_is_strict(spark, wall, hours, want):
    ts = spark.createDataFrame([(utc(wall, hours),)], "ts timestamp")
    assert align.with_signal_date(ts, calendar(spark)).first().signal_date == want


def test_early_close(spark):
    days = [date(2019, 11, 27), date(2019, 11, 29), date(2019, 12, 2)]
    ts = spark.createDataFrame([(utc("2019-11-29 12:49:00", 5),), (utc("2019-11-29 12:50:00", 5),)], "ts timestamp")
    got = {r.ts: r.signal_date for r in align.with_signal_date(ts, calendar(spark, days)).collect()}
    assert list(got.values()) == [date(2019, 11, 29), date(2019, 12, 2)]


def test_equals_the_interval_join(spark):
    start = datetime(2019, 3, 6)
    stamps = spark.range(0, 6 * 24 * 60, 7).select((F.lit(start) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).cast("timestamp").alias("ts"))
    got = {r.ts: r.signal_date for r in align.with_signal_date(stamps, calendar(spark)).collect()}
    cuts = [(utc(f"{d} 15:50:00", 5 if d < date(2019, 3, 10) else 4), d) for d in DAYS]
    assert len(got) == len(range(0, 6 * 24 * 60, 7))
    for ts, found in got.items():
        assert found == next((d for cut, d in cuts if ts < cut), None)


def test_panels(spark):
    returns = spark.createDataFrame([("A", d, 0.0, x, True, 1.0, 1) for d, x in zip(DAYS, (0.001, 0.002, -0.003, 0.004), strict=True)], "ticker string, date date, ret_next double, ret_next_excess double, eligible boolean, med_dollar_vol double, liquidity_tercile int")
    news = spark.createDataFrame([("A", utc("2019-03-08 11:00:00", 5), "x"), ("A", utc("2019-03-08 17:00:00", 5), "y"), ("Z", utc("2019-03-08 11:00:00", 5), "z")], "ticker string, ts timestamp, headline string")
    rows = align.build_panel(news, returns, calendar(spark)).orderBy("row_id").collect()
    assert [(r.row_id, r.ret_next_excess, r.y) for r in rows] == [(0, 0.002, 1), (1, -0.003, 0)]
    same = align.build_panel_same_day(news, returns, calendar(spark)).collect()
    assert [r.ret_next_excess for r in same] == [0.001, 0.001]
    assert "BroadcastNestedLoop" not in align.build_panel(news, returns, calendar(spark))._jdf.queryExecution().toString()


def test_empty_calendar(spark):
    news = spark.createDataFrame([(datetime(2019, 3, 8),)], "ts timestamp")
    assert align.with_signal_date(news, calendar(spark, []), Protocol()).first().signal_date is None
