import zipfile
from dataclasses import replace
from datetime import date, timedelta

import pytest

from tidemark import queries
from tidemark.operators import prices
from tidemark.protocol import Protocol
from tidemark.sources.prices import extract_prices, load_prices

P = replace(Protocol(), calendar_min_tickers=1)
DAYS = [date(2019, 1, 1) + timedelta(days=k) for k in range(25)]
SCHEMA = "ticker string, date date, close double, adj_close double, volume double"


def grid(spark, skip=()):
    rows = []
    for k, d in enumerate(DAYS):
        a = 10 * 1.01**k
        rows += [("A", d, a, a, 10_000 / a), ("B", d, 10.0, 10.0, 2000.0), ("C", d, 4.0, 4.0, 9000.0)]
    return spark.createDataFrame([r for r in rows if (r[0], r[1]) not in skip], SCHEMA)


def by_day(df, ticker):
    return {DAYS.index(r.date): r for r in df.where(f"ticker = '{ticker}'").collect()}


def test_universe_excess_and_terciles(spark):
    p = grid(spark)
    out = prices.build_returns(p, prices.trading_calendar(p, 3), P)
    a, b, c = (by_day(out, t) for t in "ABC")
    assert [k for k, r in sorted(a.items()) if r.eligible] == [21, 22, 23]
    assert a[22].ret_next_excess == pytest.approx(0.005) and b[22].ret_next_excess == pytest.approx(-0.005)
    assert (b[22].liquidity_tercile, a[22].liquidity_tercile) == (2, 3)
    assert not any(r.eligible for r in c.values()) and c[22].ret_next == 0 and c[22].ret_next_excess is None
    assert a[20].med_dollar_vol is None and a[21].med_dollar_vol == pytest.approx(10_000)
    assert a[24].ret_next is None


def test_rank_is_cut_before_the_return_is_asked(spark):
    p = grid(spark, skip={("B", DAYS[23])})
    out = prices.build_returns(p, prices.trading_calendar(p, 1), replace(P, universe_size=1))
    assert not by_day(out, "B")[22].eligible and not by_day(out, "A")[22].eligible


def test_gap(spark):
    p = grid(spark, skip={("A", DAYS[22])})
    a = by_day(prices.build_returns(p, prices.trading_calendar(p, 1), P), "A")
    assert a[21].ret_next is None and not a[23].eligible and 22 not in a


def test_bad_ticks(spark):
    adj = [100.0] * 25
    adj[10], adj[12], adj[13], adj[15], adj[19], adj[22] = 0.0, -1.0, -1.0, 0.2, 450.0, 400.0
    volume = [0.0 if k == 5 else 1.0 for k in range(25)]
    p = spark.createDataFrame([("A", d, 100.0, x, v) for d, x, v in zip(DAYS, adj, volume, strict=True)], SCHEMA)
    out = by_day(prices.build_returns(p, prices.trading_calendar(p, 1), replace(P, volume_window=3, splice_dates=(DAYS[7],))), "A")
    assert [k for k in range(25) if out[k].ret_next is None] == [4, 5, 7, 9, 10, 11, 12, 13, 14, 15, 18, 19, 24]


def test_rounding_is_that_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    values = [1.005, -1.005, 2.675, 0.285, 8.575, 0.0, 1e300, 1e308, float("inf"), float("-inf"), None]
    got = queries.rounded(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double"), x=2).orderBy("k").collect()
    assert [r.x for r in got] == [duckdb.execute("SELECT round(?::DOUBLE, 2)", [v]).fetchone()[0] for v in values]


def test_two_layouts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("full/AA.csv", "date,volume,open,high,low,close,adj close\n2020-01-02,100,1,1,1,20.5,20.1\n2020-01-03,,1,1,1,20,20\n")
        z.writestr("full/B B.csv", "date,open,high,low,close,adj close,volume\n2020-01-02,1,1,1,30.5,30.1,300\n")
        z.writestr("__MACOSX/full/AA.csv", "junk")
        z.writestr("full/readme.txt", "junk")
    assert extract_prices(tmp_path / "p.zip", tmp_path / "out") == 2
    got = sorted(map(tuple, load_prices(spark, str(tmp_path / "out")).collect()))
    assert got == [("AA", date(2020, 1, 2), 20.5, 20.1, 100.0), ("B B", date(2020, 1, 2), 30.5, 30.1, 300.0)]


def test_price_cells(spark, tmp_path):
    """Line ends, quotes, byte-order marks and blank lines; a column that isn't there."""
    (tmp_path / "Q.csv").write_bytes('\ufeffDate,Close,Adj Close,Volume\r\n2020-01-02,"1,000",2.5,7\r\n"2020-01-03","20.5",20.1,"100"\r\n\r\n2020-01-06,3\r\n'.encode())
    (tmp_path / "EMPTY.csv").write_text("")
    (tmp_path / "HEAD.csv").write_text("other\n")
    assert list(map(tuple, load_prices(spark, str(tmp_path)).collect())) == [("Q", date(2020, 1, 3), 20.5, 20.1, 100.0)]
    (tmp_path / "BAD.csv").write_text("date,close,volume\n2020-01-02,1,1\n")
    with pytest.raises(Exception, match="no column adj close in BAD.csv"):
        load_prices(spark, str(tmp_path)).collect()
