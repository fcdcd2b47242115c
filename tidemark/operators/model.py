"""Walk-forward fitting of a logistic head over any featurizer."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import POLARITY, polarity, tokens
from tidemark.operators import dense, tfidf
from tidemark.operators.evaluate import daily_ic, long_short
from tidemark.operators.sampling import shuffle_labels
from tidemark.operators.splits import Split, select_years, years_needed
from tidemark.protocol import Protocol

#: (train, frames to score, params, test year) -> the frames with a ``features`` vector, train first.
Featurize = Callable[[DataFrame, list[DataFrame], dict, int], list[DataFrame]]


@dataclass
class WalkForward:
    scores: DataFrame  # stock-day scores with test_year
    validation: list[dict]  # test_year, config, mean_ic (None where no day qualifies)
    validation_returns: DataFrame  # test_year, config, signal_date, net


def stock_day_scores(rows: DataFrame, column: str = "p") -> DataFrame:
    """Mean score of a ticker's headlines on a signal date."""
    constant = [F.max(c).alias(c) for c in ("ret_next_excess", "liquidity_tercile")]
    return rows.groupBy("ticker", "signal_date").agg(F.avg(column).alias("score"), *constant)


def tfidf_featurizer(protocol: Protocol = Protocol()) -> Featurize:
    def run(train: DataFrame, others: list[DataFrame], params: dict, test_year: int) -> list[DataFrame]:
        span = tuple(params["ngram"])
        terms = tfidf.vocabulary(train, span=span, min_df=protocol.min_df, max_features=protocol.max_features).cache()
        out = [tfidf.features(f, terms, span=span) for f in (train, *others)]
        terms.unpersist()
        return out

    return run


def dense_featurizer(cache: dense.EmbeddingCache, panel: DataFrame, protocol: Protocol = Protocol()) -> Featurize:
    """Embeddings of the version before the test year, standardised by the training rows. A test
    year's block, the rows of ``panel`` in the years that it needs, is embedded once; a row
    outside the block is an error, as is a cache that doesn't hold all of it."""
    blocks: dict[int, DataFrame] = {}

    def block(test_year: int) -> DataFrame:
        if test_year not in blocks:
            years = list(years_needed(protocol)[test_year])
            if test_year == protocol.holdout_start.year:  # the holdout's own rows besides those learned from
                years += range(protocol.holdout_start.year, protocol.holdout_end.year + 1)
            own = panel.where(F.year("signal_date").isin(years))
            blocks[test_year] = cache.vectors(own, dense.vintage_for(test_year, protocol))
        return blocks[test_year]

    def run(train: DataFrame, others: list[DataFrame], params: dict, test_year: int) -> list[DataFrame]:
        vectors = block(test_year)
        for f in (train, *others):
            wanted = f.select(F.year("signal_date").alias("year"), "headline").distinct()
            if wanted.join(vectors, ["year", "headline"], "left_anti").limit(1).count():
                raise ValueError(f"rows outside the block of {test_year}")
        embedded = [dense.with_vectors(f, vectors) for f in (train, *others)]
        return dense.standardise(embedded[0], embedded[1:], "embedding")

    return run


def _fitted(first: DataFrame, others: list[DataFrame], grid: Sequence[dict]) -> list[list[DataFrame]]:
    """For each configuration, the other frames with p; all frames have their features."""
    first = first.withColumn("label", F.col("y").cast("double")).cache()
    got = first.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).first()
    if not got.n or got.a == got.b:
        raise ValueError("training rows of both labels are needed")
    out = []
    for params in grid:
        head = LogisticRegression(maxIter=1000, regParam=1 / (params["C"] * got.n), elasticNetParam=0.0, standardization=False)
        model = head.fit(first)
        out.append([model.transform(f).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction") for f in others])
    first.unpersist()
    return out


def fit_predict(featurize: Featurize, train: DataFrame, others: list[DataFrame], params: dict, test_year: int) -> list[DataFrame]:
    """The other frames with p, the probability of label 1. The penalty is 1 / (2 C) times the
    squared length of the weights beside the summed loss; one class alone is an error."""
    first, *rest = featurize(train, others, params, test_year)
    return _fitted(first, rest, [params])[0]


def by_features(grid: Sequence[dict]) -> list[list[int]]:
    """Configurations that differ in C alone, and so share their features."""
    groups: dict[str, list[int]] = {}
    for k, params in enumerate(grid):
        groups.setdefault(repr(sorted((n, v) for n, v in params.items() if n != "C")), []).append(k)
    return list(groups.values())


def lexicon_scores(panel: DataFrame, lexicon: Mapping[str, float] = POLARITY) -> DataFrame:
    """Stock-day means of the headlines' polarity by the lexicon; nothing is fitted."""
    return stock_day_scores(panel.withColumn("p", polarity(tokens(F.col("headline")), lexicon)))


def walk_forward(panel: DataFrame, calendar: DataFrame, splits: Sequence[Split], featurize: Featurize, grid: Sequence[dict], protocol: Protocol = Protocol(), shuffle_seed: int | None = None) -> WalkForward:
    """For each split: fit each configuration, score the validation year, refit the best (the first
    of equal mean ICs; one without a qualifying day never wins) and score the test year. With a
    seed, training labels are permuted and evaluation labels are not."""
    scores, validation, nets = None, [], None
    for split in splits:
        train = select_years(panel, *split.select, calendar)
        valid = select_years(panel, split.validate, split.validate)
        refit = select_years(panel, *split.refit, calendar)
        test = select_years(panel, split.test, split.test)
        if shuffle_seed is not None:
            train, refit = shuffle_labels(train, shuffle_seed), shuffle_labels(refit, shuffle_seed)
        ics: dict[int, float | None] = {}
        for members in by_features(grid):  # features are worked out once for all that share them
            first, valid_features = featurize(train, [valid], grid[members[0]], split.test)
            for k, (scored,) in zip(members, _fitted(first, [valid_features], [grid[k] for k in members]), strict=True):
                days = stock_day_scores(scored).persist()  # read for the ICs and for the nets
                ics[k] = daily_ic(days, min_names=protocol.min_names).agg(F.avg("ic")).first()[0]
                net = long_short(days, protocol.min_names, protocol.cost).select(F.lit(split.test).alias("test_year"), F.lit(k).alias("config"), "signal_date", "net")
                nets = net if nets is None else nets.unionByName(net)
        validation += [{"test_year": split.test, "config": k, "mean_ic": ics[k]} for k in range(len(grid))]
        known = [k for k in range(len(grid)) if ics[k] is not None and not math.isnan(ics[k])]
        best = grid[max(known, key=lambda k: (ics[k], -k))] if known else grid[0]
        (scored,) = fit_predict(featurize, refit, [test], best, split.test)
        out = stock_day_scores(scored).withColumn("test_year", F.lit(split.test))
        scores = out if scores is None else scores.unionByName(out)
    return WalkForward(scores, validation, nets)


def best_config(validation: Sequence[dict]) -> int:
    """The configuration of the highest mean over its finite ICs, the first of equal ones."""
    found: dict[int, list[float]] = {}
    for row in validation:
        if row["mean_ic"] is not None and math.isfinite(row["mean_ic"]):
            found.setdefault(row["config"], []).append(row["mean_ic"])
    if not found:
        raise ValueError("no configuration has a finite mean validation IC")
    return min(found, key=lambda k: (-sum(found[k]) / len(found[k]), k))


def best_config_of(validation: DataFrame) -> DataFrame:
    """``best_config`` of a table of config, mean_ic: one row, or none without a finite IC."""
    finite = validation.where("mean_ic IS NOT NULL AND NOT isnan(mean_ic) AND abs(mean_ic) < double('infinity')")
    return finite.groupBy("config").agg(F.avg("mean_ic").alias("_m")).agg(F.min(F.struct(-F.col("_m"), F.col("config").alias("config"))).alias("b")).select(F.col("b.config").alias("best_config")).where("best_config IS NOT NULL")


def config_sharpe_variance(validation_returns: DataFrame) -> DataFrame:
    """Sample variance over configurations of mean / deviation of their validation nets."""
    ratio = F.when(F.stddev_samp("net") > 0, F.avg("net") / F.stddev_samp("net"))
    return validation_returns.groupBy("config").agg(ratio.alias("sr")).agg(F.var_samp("sr").alias("sr_var"))
