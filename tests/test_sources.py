import json
from datetime import datetime, timedelta

import pytest

from tidemark.protocol import Protocol
from tidemark.sources import collector, news
from tidemark.streaming.ingest import ingest_feed

CSV = 'idx,title,date,stock\n0,"Up, and away",2020-06-05 10:30:00-04:00, aapl\n1,"Up, and away",2020-06-05 10:30:00-04:00,AAPL\n2,Night,2020-01-05 00:00:00-05:00,msft\n3, Down ,2020-06-05 11:30:00-0400,ibm\n'


def test_news_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text(CSV)
    raw = news.read_csv(spark, str(tmp_path / "n.csv"))
    got = {(r.ticker, r.headline, r.ts) for r in news.load_news(raw).collect()}
    assert got == {("AAPL", "Up, and away", datetime(2020, 6, 5, 14, 30)), ("MSFT", "Night", datetime(2020, 1, 5, 5)), ("IBM", "Down", datetime(2020, 6, 5, 15, 30))}
    assert news.midnight_share(raw, "date").first()[0] == 0.25
    (tmp_path / "n.csv").write_text(CSV + "4,Naive,2020-06-05 10:30:00,x\n")
    with pytest.raises(ValueError, match="offset"):
        news.load_news(news.read_csv(spark, str(tmp_path / "n.csv")))


@pytest.mark.parametrize(
    ("stamps", "good"),
    [
        (["2020-01-05 10:00:00-05:00", "2020-06-05 10:00:00-04:00"], True),
        (["2020-01-05 10:00:00+00:00", "2020-06-05 10:00:00Z"], True),
        (["2020-01-05 10:00:00-05:00", "2020-06-05 10:00:00-05:00"], False),
        (["2020-01-05 10:00:00-04:00", "2020-06-05 10:00:00-05:00"], False),
        (["2020-01-05 10:00:00", "2020-06-05 10:00:00"], False),
    ],
)
def test_offsets_follow_clock(spark, stamps, good):
    assert news.offsets_follow_clock(spark.createDataFrame([(s,) for s in stamps], "s string"), "s")[0] is good


def item(title, at, *tickers):
    return {"title": title, "time_published": at} | ({"ticker_sentiment": [{"ticker": t, "relevance_score": s} for t, s in tickers]} if tickers else {})


def test_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([item("gap", "20220313T023000", ("A", "0.9")), item("fold", "20221106T013000", ("A", "0.9"), ("B", "0.1")), item("none", "20220601T000000")]))
    (tmp_path / "b.json").write_text(json.dumps([item("fold", "20221106T013000", ("A", "0.9"))]))
    got = news.load_feed(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("A", datetime(2022, 11, 6, 6, 30), "fold")]
    (tmp_path / "empty").mkdir()
    assert news.load_feed(spark, str(tmp_path / "empty")).columns == ["ticker", "ts", "headline"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest_feed(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/a.json").write_text(json.dumps([item("x", "20220601T100000", ("A", "0.9")), item("x", "20220601T100000", ("A", "0.9"))]))
    run()
    (tmp_path / "in/b.json").write_text(json.dumps([item("x", "20220601T100000", ("A", "0.9")), item("y", "20220601T110000", ("A", "0.9"))]))
    run()
    assert sorted(r.headline for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]


START = datetime(2022, 1, 1)


def test_collector_resumes(tmp_path):
    calls = []

    def fetch(params):
        calls.append(params["time_from"])
        return {"Note": "limit"} if len(calls) == 2 else {"feed": [{"title": params["time_from"]}]}

    go = lambda: collector.collect_feed(START, START + timedelta(days=3), tmp_path, "secret", fetch)
    with pytest.raises(collector.RateLimited):
        go()
    assert go() == 2 and calls == ["20220101T0000", "20220102T0000", "20220102T0000", "20220103T0000"]
    assert go() == 0 and not any("secret" in f.read_text() for f in tmp_path.iterdir())


def test_collector_splits(tmp_path):
    spans = []

    def fetch(p):
        a, b = (datetime.strptime(p[k], "%Y%m%dT%H%M") for k in ("time_from", "time_to"))
        spans.append((b - a) // timedelta(hours=1))
        return {"feed": [{}] * (collector.CAP if b - a > timedelta(hours=12) else 1)}

    assert collector.collect_feed(START, START + timedelta(days=1), tmp_path, "k", fetch) == 2 and spans == [24, 12, 12]
    assert len(list(tmp_path.glob("*.split"))) == 1


def test_collector_floor(tmp_path, caplog):
    assert collector.collect_feed(START, START + timedelta(minutes=2), tmp_path, "k", lambda p: {"feed": [{}] * collector.CAP}) == 1
    assert "cap" in caplog.text and Protocol().min_relevance == 0.5


def test_csv_with_and_without_breaks_in_records(spark, tmp_path):
    for name, text in (("a", 'title,date\n"one ""quoted"", word",x\nplain,y\n'), ("b", 'title,date\n"over\ntwo lines",x\nplain,y\n')):
        (tmp_path / name).write_text(text)
    assert [r.title for r in news.read_csv(spark, str(tmp_path / "a")).collect()] == ['one "quoted", word', "plain"]
    assert [r.title for r in news.read_csv(spark, str(tmp_path / "b")).collect()] == ["over\ntwo lines", "plain"]
