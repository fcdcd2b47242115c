import math
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.functions import stats
from tidemark.operators import evaluate

SCHEMA = "ticker string, signal_date date, score double, ret_next_excess double, liquidity_tercile int"
D = [date(2020, 1, 1) + timedelta(days=k) for k in range(70)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def names(day, scores, returns=None, tercile=1):
    returns = returns or [k / 100 for k in range(len(scores))]
    return [(f"T{k:02}", day, float(s), float(r), tercile) for k, (s, r) in enumerate(zip(scores, returns, strict=True))]


def test_daily_ic(spark):
    rows = names(D[0], range(20)) + names(D[1], range(20, 0, -1)) + names(D[2], [1, 2]) + names(D[3], [5] * 20) + names(D[4], range(20), [0.1] * 20)
    got = {r.signal_date: (r.ic, r.n) for r in evaluate.daily_ic(frame(spark, rows)).collect()}
    assert got == {D[0]: (pytest.approx(1), 20), D[1]: (pytest.approx(-1), 20)}


def test_nulls_drop_before_names_count(spark):
    rows = names(D[0], range(20)) + [("X", D[0], None, 0.5, 1)]
    assert evaluate.daily_ic(frame(spark, rows)).first().n == 20


def test_long_short_turns_over(spark):
    rows = names(D[0], range(20)) + names(D[1], range(20, 0, -1))
    a, b = sorted(evaluate.long_short(frame(spark, rows)).collect())
    assert (a.turnover, b.turnover) == (pytest.approx(2.0), pytest.approx(4.0))
    assert a.gross == pytest.approx(0.16) and a.net == pytest.approx(0.16 - 0.002)


def test_turnover_skips_a_day_that_is_not_traded(spark):
    rows = names(D[0], range(20)) + names(D[1], [1] * 20) + names(D[2], range(20))
    assert [r.turnover for r in sorted(evaluate.long_short(frame(spark, rows)).collect())] == [pytest.approx(2.0), pytest.approx(0.0)]


def test_ties_change_the_basket(spark):
    rows = [r for d in D[:60] for r in names(d, [k % 2 for k in range(40)])]
    legs = evaluate.quintiles(frame(spark, rows)).where("q = 5").collect()
    held = {d: frozenset(r.ticker for r in legs if r.signal_date == d) for d in D[:60]}
    assert len(set(held.values())) > 50


def test_quintile_sizes(spark):
    q = [r.q for r in evaluate.quintiles(frame(spark, names(D[0], range(23)))).collect()]
    assert [q.count(k) for k in range(1, 6)] == [4, 5, 4, 5, 5]


def test_event_study_and_lag(spark):
    cal = spark.createDataFrame([(d,) for d in D[:3]], "date date")
    returns = spark.createDataFrame([(f"T{k:02}", d, 0.0, k / 1000, True) for d in D[:3] for k in range(20)], "ticker string, date date, ret_next double, ret_next_excess double, eligible boolean")
    scores = frame(spark, names(D[1], range(20)))
    got = {(r.q, r.offset): (r.mean_r, r.cum_r) for r in evaluate.event_study(scores, returns, cal).collect()}
    assert [got[5, k][1] for k in (-1, 0, 1)] == [pytest.approx(x) for x in (0.0175, 0.035, 0.0525)]
    assert got[1, 0][0] == pytest.approx(0.0015) and (5, 2) not in got
    assert evaluate.lag_ic(scores, returns, cal).first().ic == pytest.approx(1)
    wide = {r.offset: r["5"] for r in evaluate.event_study_bps(evaluate.event_study(scores, returns, cal)).collect()}
    assert wide[0] == pytest.approx(350)


def test_newey_west_and_sharpe(spark):
    x = np.random.default_rng(1).normal(0.1, 1, 40)
    df = spark.createDataFrame([(float(v), k) for k, v in enumerate(x)], "ic double, d int")
    e = x - x.mean()
    s = (e * e).sum() + sum(2 * (1 - k / 6) * (e[k:] * e[:-k]).sum() for k in range(1, 6))
    got = stats.newey_west_t(df, "ic", "d").first()
    assert got.t == pytest.approx(x.mean() / math.sqrt(s) * len(x))
    assert df.agg(stats.sharpe("ic").alias("s")).first().s == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252))
    assert df.limit(1).agg(stats.sharpe("ic").alias("s")).first().s is None
    m = stats.moments(df, "ic").first()
    assert m.kurt == pytest.approx((e**4).mean() / (e**2).mean() ** 2) and m.skew == pytest.approx((e**3).mean() / (e**2).mean() ** 1.5)


def test_deflated_sharpe():
    assert stats.expected_max_sharpe(1, 1.0) == 0
    one, many = (stats.deflated_sharpe(500, 0.05, 1.0, 0.0, 3.0, n, 0.01) for n in (1, 50))
    assert many < one < 1


def test_groups_are_summarised_alike(spark):
    rows = [(t, d, s, r, k) for d in D[:10] for k in (1, 2) for t, _, s, r, _ in names(d, range(20), [((7 * j + d.day) % 20) / 100 for j in range(20)] if k == 1 else None)]
    both = frame(spark, rows)
    grouped = {r.tercile: r for r in evaluate.by_tercile(both).collect()}
    for k in (1, 2):
        alone = evaluate.summarise(both.where(f"liquidity_tercile = {k}")).first()
        assert (alone.days, alone.mean_ic, alone.mean_turnover) == (grouped[k].days, pytest.approx(grouped[k].mean_ic), pytest.approx(grouped[k].mean_turnover))
    assert evaluate.summarise(both.where("false")).first().days == 0


@pytest.mark.parametrize(
    ("values", "failing"),
    [
        ((3, 1, 0.05, 0.01, 0.02), set()),
        ((1.9, 1, 0.05, 0.01, 0.02), {"1_ic_t_ge_2"}),
        ((3, 0.4, 0.05, 0.01, 0.02), {"2_net_sharpe_ge_0_5"}),
        ((3, 1, 0.05, 0.03, 0.02), {"3_lag_ic_le_half"}),
        ((3, 1, -0.05, -0.9, 0.02), {"3_lag_ic_le_half"}),
        ((3, 1, 0.05, 0.01, float("nan")), {"4_holdout_ic_gt_0"}),
        ((3, 1, 0.05, 0.01, None), {"4_holdout_ic_gt_0"}),
    ],
)
def test_publish_bar(values, failing):
    bar = evaluate.publish_bar(*values)
    assert {k for k, c in bar["conditions"].items() if not c["pass"]} == failing and bar["publish"] == (not failing)


def test_publish_conditions_as_a_table(spark):
    rows = [(1, 3.0, 1.0, 0.05, 0.01, 0.02), (2, 3.0, float("nan"), 0.05, 0.03, None), (3, 1.0, 0.5, -0.05, -0.9, 0.0)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in evaluate.STATISTICS))
    got = evaluate.publish_conditions(df, ("k",)).collect()
    assert {(r.k, r.condition) for r in got if r["pass"]} == {(1, c) for c in evaluate.BAR} | {(2, "1_ic_t_ge_2"), (3, "2_net_sharpe_ge_0_5")}
    for k, *values in rows:
        assert {r.condition: r["pass"] for r in got if r.k == k} == {c: v["pass"] for c, v in evaluate.publish_bar(*values)["conditions"].items()}


def test_deflated_sharpe_values(spark):
    """Half at the expected maximum, more with a higher mean, and its value by hand."""
    rng = np.random.default_rng(3)
    draws = rng.standard_t(6, 800) * 0.01 + 0.001
    series = lambda x: stats.moments(spark.createDataFrame([(float(v),) for v in x], "net double"), "net")
    ratio = draws.mean() / draws.std(ddof=1)
    at_max = (ratio / stats.expected_max_sharpe(6, 1.0)) ** 2
    assert stats.deflated_sharpe_of(series(draws), 6, at_max) == pytest.approx(0.5, abs=1e-9)
    assert stats.deflated_sharpe_of(series(draws + 0.0005), 6, at_max) > 0.5
    e = draws - draws.mean()
    skew, kurt = (e**3).mean() / (e**2).mean() ** 1.5, (e**4).mean() / (e**2).mean() ** 2
    assert stats.expected_max_sharpe(6, 0.01) == pytest.approx(0.1 * ((1 - 0.5772156649) * 0.9674215661 + 0.5772156649 * 1.5426183436), abs=2e-3)
    z = (ratio - stats.expected_max_sharpe(6, 0.0004)) * math.sqrt(799) / math.sqrt(1 - skew * ratio + (kurt - 1) / 4 * ratio**2)
    assert stats.deflated_sharpe_of(series(draws), 6, 0.0004) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-9)
    assert math.isnan(stats.deflated_sharpe_of(series([0.1, 0.1]), 6, 0.01)) and math.isnan(stats.deflated_sharpe_of(series(draws), 6, None))
