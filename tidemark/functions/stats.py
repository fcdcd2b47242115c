"""Statistics of a series of days: aggregates as DataFrames, closed forms on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329


def newey_west_t(series: DataFrame, value: str, order: str, lags: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, days, mean, t: the mean's t with Bartlett weights 1 - l / (lags + 1) on the
    autocovariances at row lags 1 .. ``lags``. No variance gives a null t."""
    own = Window.partitionBy(*keys)
    e = series.withColumn("_e", F.col(value) - F.avg(value).over(own))
    steps = own.orderBy(order)
    weighted = F.col("_e") * F.col("_e")
    for lag in range(1, lags + 1):
        weighted += F.lit(2 * (1 - lag / (lags + 1))) * F.col("_e") * F.coalesce(F.lag("_e", lag).over(steps), F.lit(0.0))
    summed = e.withColumn("_w", weighted).groupBy(*keys).agg(F.count(value).alias("days"), F.avg(value).alias("mean"), F.sum("_w").alias("_v"))
    return summed.select(*keys, "days", "mean", F.when(F.col("_v") > 0, F.col("mean") / F.sqrt(F.col("_v") / (F.col("days") * F.col("days")))).alias("t"))


def sharpe(value: str, trading_days: int = 252) -> Column:
    """Annualised mean over sample deviation; null with one day or no deviation."""
    deviation = F.stddev_samp(value)
    return F.when(deviation > 0, F.avg(value) / deviation * F.lit(math.sqrt(trading_days)))


def moments(series: DataFrame, value: str) -> DataFrame:
    """n, mean, sample deviation, biased skewness and kurtosis (3 for a normal)."""
    return series.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))


def expected_max_sharpe(trials: int, variance: float) -> float:
    """Expected largest Sharpe ratio of so many trials without skill."""
    if trials < 2:
        return 0.0
    z = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER_GAMMA) * z(1 - 1 / trials) + EULER_GAMMA * z(1 - 1 / (trials * math.e)))


def deflated_z(found: DataFrame, trials: int, variance: float | Column) -> DataFrame:
    """``moments`` rows with sr, sr0 (expected of the best of the trials) and z, how many
    deviations of its estimate the Sharpe ratio is beyond it; null without a deviation."""
    variance = F.lit(float(variance)) if isinstance(variance, (int, float)) else variance
    ratio = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd"))
    with_ratio = found.withColumn("sr", ratio).withColumn("sr0", F.sqrt(variance) * F.lit(expected_max_sharpe(trials, 1.0)))
    spread = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    return with_ratio.withColumn("z", (F.col("sr") - F.col("sr0")) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(spread > 0, spread)))


def deflated_sharpe(n: int, mean: float, sd: float, skew: float, kurt: float, trials: int, variance: float) -> float:
    """Probability that the per-period Sharpe ratio beats the best of the trials by luck."""
    ratio = mean / sd
    spread = math.sqrt(1 - skew * ratio + (kurt - 1) / 4 * ratio**2)
    return NormalDist().cdf((ratio - expected_max_sharpe(trials, variance)) * math.sqrt(n - 1) / spread)


def deflated_sharpe_of(found: DataFrame, trials: int, variance: float | None) -> float:
    """``deflated_sharpe`` of a row of ``moments``; NaN where it isn't defined."""
    row = None if variance is None else deflated_z(found, trials, variance).first()
    return math.nan if row is None or row.z is None else NormalDist().cdf(row.z)
