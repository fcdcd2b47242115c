"""Every number of the research protocol, as one value that operators take."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, time

# Sessions of the New York exchange that close at 13:00, 2008 to 2023.
EARLY_CLOSES = tuple(
    map(
        date.fromisoformat,
        """
        2008-07-03 2008-11-28 2008-12-24 2009-11-27 2009-12-24 2010-11-26 2011-11-25 2012-07-03
        2012-11-23 2012-12-24 2013-07-03 2013-11-29 2013-12-24 2014-07-03 2014-11-28 2014-12-24
        2015-11-27 2015-12-24 2016-11-25 2017-07-03 2017-11-24 2018-07-03 2018-11-23 2018-12-24
        2019-07-03 2019-11-29 2019-12-24 2020-11-27 2020-12-24 2021-11-26 2022-11-25 2023-07-03
        2023-11-24
        """.split(),
    )
)


@dataclass(frozen=True)
class Protocol:
    # clock
    zone: str = "America/New_York"
    cutoff: time = time(15, 50)
    early_cutoff: time = time(12, 50)
    early_closes: tuple[date, ...] = EARLY_CLOSES
    # universe
    calendar_min_tickers: int = 500
    min_price: float = 5.0
    universe_size: int = 1000
    volume_window: int = 21
    max_ratio: float = 4.0
    splice_dates: tuple[date, ...] = (date(2014, 12, 31), date(2020, 4, 1), date(2020, 7, 2))
    # models
    test_years: tuple[int, ...] = tuple(range(2013, 2021))
    train_years: int = 4
    dense_grid: tuple[dict, ...] = tuple({"C": c} for c in (0.001, 0.01, 0.1, 1.0, 10.0, 100.0))
    tfidf_grid: tuple[dict, ...] = tuple({"ngram": n, "C": c} for n in ((1, 1), (1, 2)) for c in (0.1, 1.0, 10.0))
    min_df: int = 5
    max_features: int = 50_000
    model_template: str = "encoder-{year}1231"
    model_gb: float = 0.6
    embed_dim: int = 768
    max_tokens: int = 64
    embed_batch: int = 256
    holdout_train_years: tuple[int, int] = (2017, 2020)
    holdout_start: date = date(2022, 1, 1)
    holdout_end: date = date(2023, 12, 28)
    # evaluation
    min_names: int = 20
    cost: float = 0.0010
    hac_lags: int = 5
    trading_days: int = 252
    null_max_t: float = 2.0
    offsets: tuple[int, ...] = (-1, 0, 1, 2, 3, 4, 5)
    # gates
    max_midnight_share: float = 0.05
    min_clock_agreement: float = 0.99
    max_collection_days: int = 90
    min_holdout_days: int = 100
    max_embed_hours: float = 12.0
    disk_headroom_gb: float = 5.0
    benchmark_headlines: int = 10_000
    max_ram_fraction: float = 0.6
    fit_overhead_gb: float = 1.0
    # sources; the dataset's id and file name are fixed values
    dataset: str = "miguelaenlle/massive-stock-news-analysis-db-for-nlpbacktests"
    dataset_file: str = "analyst_ratings_processed.csv"
    headline_col: str = "title"
    stamp_col: str = "date"
    ticker_col: str = "stock"
    min_relevance: float = 0.5
    feed_zone: str = field(default="America/New_York")
