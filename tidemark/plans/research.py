"""The twelve steps from raw files to a report; between steps the state is files."""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import align, dense, evaluate, model, sampling, splits
from tidemark.operators import prices as price_ops
from tidemark.plans.gates import Gates, Refused, embed_projection, qualifying_days, year_counts
from tidemark.plans.report import build_report
from tidemark.protocol import Protocol
from tidemark.sources import collector, news
from tidemark.sources import prices as price_source
from tidemark.sources.results import read_json, write_json

SUMMARY = ("days", "mean_ic", "ic_t", "net_sharpe", "gross_sharpe", "mean_turnover")


def _row(df: DataFrame) -> dict:
    found = df.first()
    return {k: (None if found is None else found[k]) for k in df.columns}


@dataclass
class Research:
    spark: SparkSession
    root: Path
    protocol: Protocol = field(default_factory=Protocol)
    embedder: Callable[[str], dense.Embedder] = dense.HashingEmbedder
    fetch: Callable[[dict], dict] | None = None

    def __post_init__(self):
        self.raw, self.processed, self.results = self.root / "data/raw", self.root / "data/processed", self.root / "results"
        self.gates = Gates(self.results, self.protocol)
        self.cache = dense.EmbeddingCache(self.spark, str(self.root / "data/embeddings"), self.embedder, self.protocol)

    # tables
    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.processed / f"{name}.parquet"))

    def write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(str(self.processed / f"{name}.parquet"))

    def _numbered(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows with their numbers; they are written first, as numbering reads them twice."""
        self.write(rows, f"{name}_rows")
        return align.numbered(self.read(f"{name}_rows"))

    def _grid(self, name: str) -> tuple[dict, ...]:
        return self.protocol.dense_grid if name == "chrono" else self.protocol.tfidf_grid

    def _featurize(self, name: str, panel: DataFrame) -> model.Featurize:
        return model.dense_featurizer(self.cache, panel, self.protocol) if name == "chrono" else model.tfidf_featurizer(self.protocol)

    # 1
    def gate_g1(self, file: str, licence: str, licence_ok: bool) -> dict:
        self.gates.require_open()
        raw, p = news.read_csv(self.spark, file), self.protocol
        raw.show(3)
        share = news.midnight_share(raw, p.stamp_col).first()[0]
        follows, agreement = news.offsets_follow_clock(raw, p.stamp_col, p)
        try:
            parsed, rows = True, news.load_news(raw, p).count()
        except ValueError as err:
            parsed, rows = False, str(err)
        offsets = {r.utc_offset: r.n for r in news.offset_counts(raw, p.stamp_col).collect()}
        good = licence_ok and parsed and share is not None and share < p.max_midnight_share and follows
        return self.gates.record("G1", {"file": Path(file).name, "licence": licence, "licence_ok": licence_ok, "midnight_share": share, "utc_offset_parse_ok": parsed, "utc_offsets": offsets, "new_york_wall_time_share": agreement, "offsets_follow_dst": follows, "rows": rows, "pass": good})

    # 2
    def prices(self, archive: str) -> None:
        """The archive is unpacked into the root, which the driver and the executors share."""
        folder = self.raw / "prices"
        print("extracted", price_source.extract_prices(archive, folder), "price files")
        daily = price_source.load_prices(self.spark, str(folder))
        self.write(price_ops.trading_calendar(daily, self.protocol.calendar_min_tickers), "calendar")
        self.write(price_ops.build_returns(daily, self.read("calendar"), self.protocol), "returns")
        self.read("returns").where("eligible").groupBy(F.year("date").alias("year")).count().orderBy("year").show()

    # 3
    def panel(self, file: str) -> None:
        headlines = news.load_news(news.read_csv(self.spark, file), self.protocol)
        inputs = headlines, self.read("returns"), self.read("calendar"), self.protocol
        self.write(self._numbered(align.aligned(*inputs), "panel"), "panel")
        self.write(self._numbered(align.aligned_same_day(*inputs), "panel_same_day"), "panel_same_day")
        self.read("panel").groupBy(F.year("signal_date").alias("year")).count().orderBy("year").show()

    # 4
    def gate_g4(self) -> dict:
        self.gates.require_open()
        p, panel = self.protocol, self.read("panel")
        last = max(p.test_years)
        own = panel.where(F.year("signal_date") == last)
        sample = [r.headline for r in sampling.seeded_sample(own, "headline", p.benchmark_headlines).collect()]  # so many at most
        embedder = self.embedder(dense.vintage_for(last, p))
        embedder.embed(sample[:512])
        began = time.perf_counter()
        embedder.embed(sample)
        rate = len(sample) / max(time.perf_counter() - began, 1e-9)
        years = year_counts(panel).collect()  # a row a year
        ram = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 1e9
        return self.gates.record("G4", embed_projection({r.year: r.distinct_texts for r in years}, {r.year: r.rows for r in years}, rate, shutil.disk_usage(self.root).free / 1e9, ram, p))

    def _span(self) -> tuple[datetime, datetime]:
        at = lambda d: datetime.combine(d, datetime.min.time())
        return at(self.protocol.holdout_start) - timedelta(days=1), at(self.protocol.holdout_end) + timedelta(days=1)

    def _collect(self, a: datetime, b: datetime, folder: Path, pause: float = 0.0) -> int:
        key = os.environ.get("FEED_KEY")
        endpoint = os.environ.get("FEED_URL")
        if self.fetch is None and not (key and endpoint):
            raise Refused("FEED_URL and FEED_KEY name the feed and its key")
        return collector.collect_feed(a, b, folder, key or "", self.fetch or collector.http_fetch(endpoint), pause=pause)

    # 5
    def gate_g2(self, days: int, daily_limit: int) -> dict:
        self.gates.require_open()
        p, probe = self.protocol, self.raw / "feed_probe"
        chosen = sampling.probe_days(p.holdout_start, p.holdout_end, days)
        fetched = sum(self._collect(a := datetime.combine(d, datetime.min.time()), a + timedelta(days=1), probe) for d in chosen)
        years = sorted(r[0] for r in news.load_feed(self.spark, str(probe), p).select(F.year(F.from_utc_timestamp("ts", p.zone))).distinct().collect())
        prefixes = {f"{d:%Y%m%d}" for d in chosen}
        requests = sum(f.suffix in (".json", ".split") and f.name[:8] in prefixes for f in probe.iterdir())
        start, end = self._span()
        projected = requests / len(chosen) * (end - start).days
        wanted = set(range(p.holdout_start.year, p.holdout_end.year + 1))
        return self.gates.record("G2ab", {"probe_days": [str(d) for d in chosen], "windows_fetched": fetched, "years_with_headlines": years, "projected_requests": projected, "daily_limit": daily_limit, "projected_collection_days": projected / daily_limit, "timezone_assumed": p.feed_zone, "pass": wanted <= set(years) and projected / daily_limit <= p.max_collection_days})

    # 6
    def collect_feed(self, pause: float = 0.0) -> int:
        fetched = self._collect(*self._span(), self.raw / "feed", pause)
        print("windows fetched by this run:", fetched)
        return fetched

    # 7
    def holdout_panel(self) -> dict:
        self.gates.require_open()
        p = self.protocol
        rows = align.aligned(news.load_feed(self.spark, str(self.raw / "feed"), p), self.read("returns"), self.read("calendar"), p)
        panel = self._numbered(rows, "panel_holdout")
        self.write(panel.where(F.col("signal_date").between(F.lit(p.holdout_start), F.lit(p.holdout_end))), "panel_holdout")
        held = self.read("panel_holdout")
        days = qualifying_days(held, p.min_names).first()[0]
        return self.gates.record("G2c", {"holdout_rows": held.count(), "qualifying_days": days, "pass": days >= p.min_holdout_days})

    # 8
    def run(self, name: str, null: bool = False) -> dict:
        if name not in (self.gates.primary(), "tfidf"):
            raise Refused(f"gate G4 made {self.gates.primary()} the primary; {name} is not allowed")
        p, calendar = self.protocol, self.read("calendar")
        got = model.walk_forward(self.read("panel"), calendar, splits.walk_forward_splits(p.test_years, p.train_years), self._featurize(name, self.read("panel")), self._grid(name), p, 0 if null else None)
        out = f"{name}_null" if null else name
        self.write(got.scores, f"{out}_scores")
        self.write(got.validation_returns, f"{out}_validation_returns")
        scores = self.read(f"{out}_scores")
        by_year = {r.test_year: {k: r[k] for k in SUMMARY} for r in evaluate.summarise(scores, p, ("test_year",)).collect()}
        overall = _row(evaluate.summarise(scores, p).select(*SUMMARY))
        empty = dict.fromkeys(SUMMARY) | {"days": 0}
        write_json(self.results / f"{out}.json", {"overall": overall, "validation": got.validation, "by_year": [{"test_year": y, **by_year.get(y, empty)} for y in p.test_years]})
        return overall

    # 9
    def lexicon(self) -> None:
        self.gates.primary()
        for name, source in (("vader", "panel"), ("old_bug_vader", "panel_same_day")):
            panel = self.read(source).where(F.year("signal_date").isin(*self.protocol.test_years))
            self.write(model.lexicon_scores(panel), f"{name}_scores")
            scores = self.read(f"{name}_scores")  # so that the plans below don't repeat the lexicon
            overall = _row(evaluate.summarise(scores, self.protocol).select(*SUMMARY)) | _row(evaluate.hit_rate(scores))
            write_json(self.results / f"{name}.json", {"overall": overall})

    # 10
    def holdout(self) -> dict:
        name, p = self.gates.primary(), self.protocol
        self.gates.require_clean_null(name)
        done = read_json(self.results / f"{name}.json")
        if "validation" not in done:
            raise Refused(f"run the model {name} first")
        params = self._grid(name)[model.best_config(done["validation"])]
        train = splits.select_years(self.read("panel"), *p.holdout_train_years, self.read("calendar"))
        (scored,) = model.fit_predict(self._featurize(name, self.read("panel").unionByName(self.read("panel_holdout"))), train, [self.read("panel_holdout")], params, p.holdout_start.year)
        self.write(model.stock_day_scores(scored), "holdout_scores")
        got = evaluate.daily_ic(self.read("holdout_scores"), min_names=p.min_names).agg(F.count("ic").alias("days"), F.avg("ic").alias("mean_ic")).first()
        write_json(self.results / "holdout.json", {"model": name, "params": params, "days": got.days, "mean_ic": got.mean_ic})
        return read_json(self.results / "holdout.json")

    # 11
    def summarize(self) -> dict:
        name, p, calendar = self.gates.primary(), self.protocol, self.read("calendar")
        self.gates.require_clean_null(name)
        held = read_json(self.results / "holdout.json")
        if held.get("model") != name:
            raise Refused(f"results/holdout.json is missing or not from {name}: run the holdout first")
        scores, returns = self.read(f"{name}_scores"), self.read("returns")
        primary = read_json(self.results / f"{name}.json")["overall"]
        lag = evaluate.lag_ic(scores, returns, calendar, p.min_names).agg(F.avg("ic")).first()[0]
        variance = model.config_sharpe_variance(self.read(f"{name}_validation_returns")).first()[0]
        deflated = stats.deflated_sharpe_of(stats.moments(evaluate.long_short(scores, p.min_names, p.cost), "net"), len(self._grid(name)), variance)
        bar = evaluate.publish_bar(primary["ic_t"], primary["net_sharpe"], primary["mean_ic"], lag, held["mean_ic"])
        terciles = [r.asDict() for r in evaluate.by_tercile(scores, p).orderBy("tercile").collect()]
        study = [r.asDict() for r in evaluate.event_study(scores, returns, calendar, p.offsets, p.min_names).orderBy("q", "offset").collect()]
        write_json(self.results / "summary.json", {"primary": name, "bar": bar, "mean_lag_ic": lag, "deflated_sharpe": deflated, "terciles": terciles, "event_study": study})
        return bar

    # 12
    def report(self) -> Path:
        self.gates.require_clean_null(self.gates.primary())
        if not (self.results / "summary.json").exists():
            raise Refused("summarize first")
        build_report(self.results, self.root / "REPORT.md")
        return self.root / "REPORT.md"
