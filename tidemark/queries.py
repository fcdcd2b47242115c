"""Queries over the driver's tables, each with its SQL where there is one.

Adapters: prices are the events' users by day (close = adj_close = mean value, volume = rows); news
are the events (ticker = user, headline = type); a panel over years is the line items by supplier
and ship date; texts are the documents.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import stats, text
from tidemark.functions.clock import stripped, wall_time
from tidemark.operators import align, dense, evaluate, model, prices, sampling, splits, tfidf
from tidemark.plans import gates
from tidemark.protocol import Protocol
from tidemark.sources import news as news_source

EV = replace(Protocol(), calendar_min_tickers=1, min_price=0.0, volume_window=5, universe_size=80)
EV_EARLY = replace(EV, early_closes=(date(2024, 1, 10),))
NAMES = 20
#: A lexicon of event types, which are the headlines of the events.
EVENT_POLARITY = {"error": -1.3, "click": 0.2, "purchase": 1.1, "view": 0.1, "signup": 1.5, "login": 0.3, "logout": -0.2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_prices(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("date").alias("date"))
    return e.agg(F.avg("value").alias("close"), F.avg("value").alias("adj_close"), F.count(F.lit(1)).cast("double").alias("volume"))


def ev_news(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("headline"))


def ev_calendar(spark, d):
    return prices.trading_calendar(ev_prices(spark, d), 1)


def ev_returns(spark, d):
    return prices.build_returns(ev_prices(spark, d), ev_calendar(spark, d), EV)


def ev_scores(spark, d):
    p = ev_prices(spark, d).select("ticker", F.col("date").alias("signal_date"), (-F.col("close")).alias("score"))
    r = ev_returns(spark, d).where("eligible").select("ticker", F.col("date").alias("signal_date"), "ret_next_excess", F.col("liquidity_tercile").cast("int").alias("liquidity_tercile"))
    return p.join(r, ["ticker", "signal_date"])


def li_scores(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("date").alias("signal_date"))
    return li.agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("score"), F.round(F.avg("l_discount") - 0.05, 9).alias("ret_next_excess")).withColumn("test_year", F.year("signal_date")).withColumn("liquidity_tercile", F.lit(1))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded as DuckDB does, by way of the multiple that is kept: Spark's own rounding
    goes by a value's decimal digits, so it parts from it next to a tie."""

    def one(c: str, n: int):
        scaled = F.col(c) * F.lit(10.0**n)
        return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / F.lit(10.0**n)).otherwise(F.col(c))

    return df.withColumns({c: one(c, n) if df.schema[c].dataType.typeName() == "double" else F.round(c, n) for c, n in digits.items()})


def trading_calendar(spark, d):
    return prices.trading_calendar(ev_prices(spark, d), 11)


def calendar_neighbours(spark, d):
    return prices.neighbours(ev_calendar(spark, d))


def rolling_median_dollar_volume(spark, d):
    r = prices.next_returns(ev_prices(spark, d), ev_calendar(spark, d), EV)
    return rounded(r.where("med_dollar_vol IS NOT NULL").select("ticker", "date", "med_dollar_vol"), med_dollar_vol=6)


def next_day_returns(spark, d):
    r = prices.next_returns(ev_prices(spark, d), ev_calendar(spark, d), EV)
    return rounded(r.where("ret_next IS NOT NULL").select("ticker", "date", "ret_next"), ret_next=8)


def universe_topk(spark, d):
    return ev_returns(spark, d).where("eligible").select("ticker", "date")


def market_excess(spark, d):
    return rounded(ev_returns(spark, d).where("eligible").select("ticker", "date", "ret_next_excess"), ret_next_excess=8)


def liquidity_terciles(spark, d):
    return ev_returns(spark, d).where("eligible").select("ticker", "date", F.col("liquidity_tercile").cast("int").alias("tercile"))


def build_returns_full(spark, d):
    r = ev_returns(spark, d).withColumn("liquidity_tercile", F.col("liquidity_tercile").cast("int"))
    return rounded(r, ret_next=8, ret_next_excess=8, med_dollar_vol=6)


def _dated(spark, d, protocol):
    # the calendar of every third day leaves gaps, as weekends do
    cal = ev_calendar(spark, d).where(F.dayofmonth("date") % 3 == 1)
    out = align.with_signal_date(table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), cal, protocol)
    return out.select("event_id", "signal_date")


def signal_date_asof(spark, d):
    return _dated(spark, d, EV)


def signal_date_early_close(spark, d):
    return _dated(spark, d, EV_EARLY)


def panel_next_day(spark, d):
    p = align.build_panel(ev_news(spark, d), ev_returns(spark, d), ev_calendar(spark, d), EV)
    return p.groupBy("ticker", "signal_date").agg(F.count(F.lit(1)).alias("n"), F.max("y").cast("int").alias("y"), F.round(F.max("ret_next_excess"), 8).alias("excess"))


def panel_row_ids(spark, d):
    p = align.build_panel(ev_news(spark, d), ev_returns(spark, d), ev_calendar(spark, d), EV)
    return p.groupBy("signal_date").agg(F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"), F.countDistinct("row_id").alias("ids"))


def panel_same_day(spark, d):
    p = align.build_panel_same_day(ev_news(spark, d), ev_returns(spark, d), ev_calendar(spark, d), EV)
    return p.groupBy("ticker", "signal_date").agg(F.count(F.lit(1)).alias("n"), F.max("y").cast("int").alias("y"), F.round(F.max("ret_next_excess"), 8).alias("excess"))


def news_dedup(spark, d):
    stamp = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd 00:00:00+00:00")
    raw = table(spark, d, "events").select(F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit("\t")).alias("stock"), stamp.alias("date"), F.concat(F.lit(" "), F.col("event_type")).alias("title"))
    return news_source.clean_news(raw).select("ticker", wall_time(F.col("ts"), "UTC").cast("date").alias("day"), "headline")


def year_block_embargo(spark, d):
    scores = li_scores(spark, d)
    cal = scores.select(F.col("signal_date").alias("date")).distinct()
    return splits.select_years(scores, 1996, 1998, cal).groupBy("test_year").agg(F.count(F.lit(1)).alias("n"), F.max("signal_date").alias("last_day"))


def stock_day_scores(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("date").alias("signal_date"), F.col("value").alias("p"), F.lit(0.5).alias("ret_next_excess"), F.lit(1).alias("liquidity_tercile"))
    return rounded(model.stock_day_scores(e), score=8)


def daily_rank_ic(spark, d):
    return rounded(evaluate.daily_ic(ev_scores(spark, d), min_names=NAMES), ic=8)


def lag_ic(spark, d):
    return rounded(evaluate.lag_ic(ev_scores(spark, d), ev_returns(spark, d), ev_calendar(spark, d), NAMES), ic=8)


def quintiles_hash_ties(spark, d):
    tied = ev_scores(spark, d).withColumn("score", F.floor(F.col("score") / 50).cast("double"))
    return evaluate.quintiles(tied, NAMES).select("ticker", "signal_date", F.col("q").cast("int").alias("q"))


def long_short_daily(spark, d):
    return rounded(evaluate.long_short(ev_scores(spark, d), NAMES), gross=8, turnover=8, cost=8, net=8)


def turnover_full_outer(spark, d):
    legs = evaluate.leg_weights(ev_scores(spark, d), NAMES)
    return rounded(evaluate.turnover(legs), turnover=8)


def event_study(spark, d):
    s = evaluate.event_study(ev_scores(spark, d), ev_returns(spark, d), ev_calendar(spark, d), min_names=NAMES)
    return rounded(s.withColumn("q", F.col("q").cast("int")), mean_r=8, cum_r=8)


def event_study_pivot_bps(spark, d):
    s = evaluate.event_study(ev_scores(spark, d), ev_returns(spark, d), ev_calendar(spark, d), min_names=NAMES)
    wide = evaluate.event_study_bps(s)
    return wide.select("offset", *(F.round(str(q), 4).alias(f"q{q}") for q in range(1, 6)))


def newey_west_t(spark, d):
    ic = evaluate.daily_ic(ev_scores(spark, d), min_names=NAMES)
    return rounded(stats.newey_west_t(ic, "ic", "signal_date"), mean=8, t=6)


def annualised_sharpe(spark, d):
    ls = evaluate.long_short(ev_scores(spark, d), NAMES)
    return ls.agg(F.round(stats.sharpe("net"), 6).alias("net_sharpe"), F.round(stats.sharpe("gross"), 6).alias("gross_sharpe"))


def return_moments(spark, d):
    return rounded(stats.moments(evaluate.long_short(ev_scores(spark, d), NAMES), "net"), mean=8, sd=8, skew=6, kurt=6)


def _summary(df):
    return rounded(df, mean_ic=8, ic_t=6, net_sharpe=6, gross_sharpe=6, mean_turnover=8)


def summary_by_tercile(spark, d):
    return _summary(evaluate.by_tercile(ev_scores(spark, d), replace(EV, min_names=5)))


def summary_by_year(spark, d):
    return _summary(evaluate.summarise(li_scores(spark, d), replace(EV, min_names=10), ("test_year",)))


def summary_overall(spark, d):
    return _summary(evaluate.summarise(ev_scores(spark, d), replace(EV, min_names=NAMES)))


def _config_nets(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_linenumber").alias("config"), (F.col("l_discount") - F.col("l_tax")).alias("net"))


def config_sharpe_variance(spark, d):
    return rounded(model.config_sharpe_variance(_config_nets(spark, d)), sr_var=10)


def best_config(spark, d):
    ics = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("config"), F.year("l_shipdate").alias("test_year")).agg(F.round(F.avg("l_discount"), 9).alias("mean_ic"))
    return model.best_config_of(ics).select(F.col("best_config").cast("int").alias("best_config"))


def names_per_day_gate(spark, d):
    panel = ev_news(spark, d).withColumn("signal_date", F.col("ts").cast("date"))
    return gates.qualifying_days(panel, 20)


def publish_conditions(spark, d):
    s = summary_by_year(spark, d)
    return evaluate.publish_conditions(s.select("test_year", "ic_t", "net_sharpe", "mean_ic", (F.col("mean_turnover") / 100).alias("mean_lag_ic"), F.col("gross_sharpe").alias("holdout_mean_ic")), ("test_year",))


def deflated_sharpe_z(spark, d):
    found = stats.moments(evaluate.long_short(ev_scores(spark, d), NAMES), "net")
    z = stats.deflated_z(found, 6, 0.01)
    return z.select("n", F.round("sr", 8).alias("sr"), F.round("sr0", 8).alias("sr0"), F.round("z", 6).alias("z"))


def embedding_blocks(spark, d):
    p = replace(Protocol(), test_years=(1996, 1997, 1998), train_years=2, holdout_train_years=(1995, 1998), holdout_start=date(2000, 1, 1))
    orders = table(spark, d, "orders").select(F.col("o_orderdate").alias("signal_date"), F.col("o_orderpriority").alias("headline"))
    return gates.block_totals(gates.year_counts(orders), p)


def _stamps(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    written = F.date_format(wall_time(F.col("ts"), "America/New_York"), "yyyy-MM-dd HH:mm:ss")
    offset = F.when(F.col("event_id") % 7 == 0, F.lit("+00:00")).when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.lit("-05:00"))
    return e.select(F.when(F.col("event_id") % 5 == 0, F.concat(F.substring(written, 1, 10), F.lit(" 00:00:00"), offset)).otherwise(F.concat(written, offset)).alias("stamp"))


def midnight_share(spark, d):
    return rounded(news_source.midnight_share(_stamps(spark, d), "stamp"), midnight_share=9)


def offset_value_counts(spark, d):
    return news_source.offset_counts(_stamps(spark, d), "stamp")


def dst_agreement(spark, d):
    return rounded(news_source.clock_agreement(_stamps(spark, d), "stamp"), agreement=9)


def _labelled(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") > 200_000).cast("int").alias("y"))


def label_shuffle_rows(spark, d):
    return sampling.shuffle_labels(_labelled(spark, d), 0)


def label_shuffle_counts(spark, d):
    both = _labelled(spark, d).join(label_shuffle_rows(spark, d).withColumnRenamed("y", "shuffled"), "row_id")
    return both.groupBy("y", "shuffled").agg(F.count(F.lit(1)).alias("n"))


def seeded_sample(spark, d):
    return sampling.seeded_sample(table(spark, d, "documents"), "doc_id", 100)


def hit_rate(spark, d):
    return rounded(evaluate.hit_rate(ev_scores(spark, d).withColumn("score", F.col("score") + 50)), hit_rate=9)


def year_unique_headlines(spark, d):
    return gates.year_counts(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "headline"), "o_orderdate")


def feed_explode_relevance(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("title"), F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("time_published"), F.concat(F.lit('[{"ticker":"'), F.col("user_id").cast("string"), F.lit('","relevance_score":"'), (F.col("event_id") % 10 / 10).cast("string"), F.lit('"}]')).alias("j"))
    items = e.select("title", "time_published", F.from_json("j", "array<struct<ticker:string,relevance_score:string>>").alias("ticker_sentiment"))
    return news_source.feed_items(items).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"))


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("headline"))


def tfidf_vocab(spark, d):
    return rounded(tfidf.vocabulary(_docs(spark, d)).select("term", "df", "total", "idf"), idf=8)


def tfidf_weights(spark, d):
    docs = _docs(spark, d)
    return rounded(tfidf.weights(docs, tfidf.vocabulary(docs)).select("row_id", "term", "tf", "weight"), weight=7)


def tfidf_bigrams(spark, d):
    return tfidf.vocabulary(_docs(spark, d), span=(1, 2), min_df=20).select("term", "df", "total")


def lexicon_scores(spark, d):
    return rounded(_docs(spark, d).select("row_id", text.polarity(text.tokens(F.col("headline"))).alias("score")), score=8)


def event_lexicon_scores(spark, d):
    panel = ev_news(spark, d).withColumns({"signal_date": F.col("ts").cast("date"), "ret_next_excess": F.lit(0.0), "liquidity_tercile": F.lit(1)})
    return rounded(model.lexicon_scores(panel, EVENT_POLARITY), score=8)


def standardise_embeddings(spark, d):
    return rounded(dense.moments_of(table(spark, d, "embeddings"), "embedding"), mean=6, scale=6)


def mean_pool_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    tokens = e.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("m"))
    hidden = F.transform("m", lambda x: F.transform(x["embedding"], lambda v: v.cast("double")))
    mask = F.transform("m", lambda x: (x["vec_id"] % 2).cast("double"))
    pooled = tokens.select("label", dense.mean_pool(hidden, mask, 64).alias("pooled"))
    return rounded(pooled.select("label", F.posexplode("pooled").alias("place", "value")), value=7)


def logistic_scores(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y"))
    train, rest = e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0")
    (scored,) = model.fit_predict(lambda tr, ev, p, y: dense.standardise(tr, ev, "embedding"), train, [rest], {"C": 1.0}, 2000)
    return rounded(scored.select("vec_id", "y", "p"), p=6)


def walk_forward_scores(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    days = F.date_add(F.lit("2009-01-01").cast("date"), (F.col("doc_id") * 37 % 1826).cast("int"))
    panel = docs.select(F.col("doc_id").alias("row_id"), F.col("source").alias("ticker"), F.col("text").alias("headline"), F.date_trunc("month", days).cast("date").alias("signal_date"), (F.col("quality") - 0.5).alias("ret_next_excess"), F.lit(1).alias("liquidity_tercile"), F.col("quality").alias("y"))
    cal = panel.select(F.col("signal_date").alias("date")).distinct()
    p = replace(Protocol(), min_names=2, train_years=4)
    got = model.walk_forward(panel, cal, splits.walk_forward_splits([2013]), model.tfidf_featurizer(p), [{"ngram": (1, 1), "C": 1.0}], p)
    return rounded(got.scores, score=5)


def collector_windows(spark, d):
    from datetime import datetime, timedelta

    from tidemark.sources.collector import windows

    got = windows(datetime(2024, 1, 1), datetime(2024, 1, 4, 12), timedelta(days=1))
    return spark.createDataFrame([(str(a), str(b)) for a, b in got], "window_start string, window_end string")


QUERIES = [
    build_returns_full, trading_calendar, calendar_neighbours, rolling_median_dollar_volume, next_day_returns,
    universe_topk, market_excess, liquidity_terciles, signal_date_asof, signal_date_early_close, panel_next_day,
    panel_row_ids, panel_same_day, news_dedup, year_block_embargo, stock_day_scores, daily_rank_ic, lag_ic,
    quintiles_hash_ties, long_short_daily, turnover_full_outer, event_study, event_study_pivot_bps, newey_west_t,
    annualised_sharpe, return_moments, summary_by_tercile, summary_by_year, summary_overall,
    config_sharpe_variance, best_config, names_per_day_gate, midnight_share, offset_value_counts, dst_agreement,
    label_shuffle_rows, label_shuffle_counts, publish_conditions, deflated_sharpe_z, embedding_blocks, seeded_sample, hit_rate, year_unique_headlines, feed_explode_relevance, tfidf_vocab,
    tfidf_weights, tfidf_bigrams, lexicon_scores, event_lexicon_scores, standardise_embeddings,
    mean_pool_embeddings, logistic_scores, walk_forward_scores, collector_windows,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
