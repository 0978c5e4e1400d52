"""Variants on literal rows: edges that the tables don't hold."""

import datetime

import numpy as np
import pytest

from quantloom.operators import backtest, factors, fitness, metrics, panel, portfolio, validate
from quantloom.sources import tables

DAY = datetime.date(2024, 1, 1)  # a Monday


def day(k):
    return DAY + datetime.timedelta(days=k)


def curve(spark, values):
    return spark.createDataFrame([(day(k), v) for k, v in enumerate(values)], "date date, equity double")


def test_curve_measures(spark):
    v = np.array([100, 110, 99, 120, 114.0])
    r = v[1:] / v[:-1] - 1
    one = metrics.curve_performance(curve(spark, [*v[:3].tolist(), None, *v[3:].tolist(), float("nan")])).first()
    assert (one.n, one.total_return, one.max_drawdown) == (5, pytest.approx(0.14), pytest.approx(-0.1))
    assert one.cagr == pytest.approx(1.14 ** (365.25 / 5) - 1) and one.sharpe == pytest.approx(r.mean() / r.std(ddof=1) * 252**0.5)
    assert one.sortino == pytest.approx(r.mean() / r[r < 0].std(ddof=1) * 252**0.5) and one.calmar == pytest.approx(one.cagr / 0.1) and one.stopped is False
    other = metrics.curve_performance(curve(spark, v.tolist()), ddof=0, calendar=False, none=0.0, floor=1e-8).first()
    assert other.cagr == pytest.approx(1.14 ** (252 / 5) - 1) and other.volatility == pytest.approx(r.std() * 252**0.5)
    rising = metrics.curve_performance(curve(spark, [1.0, 2.0, 4.0])).first()
    assert (rising.sharpe, rising.sortino, rising.calmar, rising.max_drawdown) == (None, None, None, 0.0)
    assert metrics.curve_performance(curve(spark, [1.0, 2.0, 4.0]), none=0.0).first().sortino == 0.0
    lost = metrics.curve_performance(curve(spark, [1.0, 0.5, -1.0])).first()
    assert lost.cagr == -1.0 and lost.stopped
    assert metrics.curve_performance(curve(spark, [1.0])).first().cagr is None


def test_checked_forward_returns(spark):
    rows = [("a", day(0), 0.0, 10.0), ("a", day(1), 0.0, 12.0), ("a", day(2), 10.0, None), ("a", day(3), 10.0, 15.0), ("b", day(0), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "code string, date date, open double, close double")
    got = {(r.code, r.date): (r.forward_return, r.forward_return_valid, r.exit_date) for r in panel.forward_returns(df).collect()}
    assert got == {("a", day(0)): (None, False, day(1)), ("a", day(1)): (None, False, day(2)), ("a", day(2)): (0.5, True, day(3)), ("a", day(3)): (None, False, None), ("b", day(0)): (None, False, None)}
    same = panel.forward_returns(df, 1, "close", same_day=True, positive=False)
    assert {r.forward_return for r in same.where("code = 'a'").collect()} == {0.19999999999999996, None}
    stats = panel.forward_return_stats(panel.forward_returns(df)).first()
    assert tuple(stats)[:5] == (5, 1, 4, 0.5, 0.5) and stats["std"] == 0.0


def test_calendars(spark):
    week = panel.weekday_calendar(spark, "2024-01-05", "2024-01-09")
    assert [(r.date, r.ordinal) for r in week.orderBy("date").collect()] == [(day(4), 0), (day(7), 1), (day(8), 2)]
    assert panel.weekday_calendar(spark, "2024-01-09", "2024-01-05").count() == 0
    dates = spark.createDataFrame([(day(k),) for k in (3, 4, 5, 7, 8, 9)], "date date")
    forward = {r.date: r.nearest for r in panel.nearest_day(dates, week, True).collect()}
    assert forward == {day(3): day(4), day(4): day(4), day(5): day(7), day(7): day(7), day(8): day(8), day(9): None}
    assert {r.date: r.nearest for r in panel.nearest_day(dates, week).collect()}[day(5)] == day(4)
    assert {r.date: r.shifted for r in panel.shift_from(dates, week, 1).collect()}[day(5)] == day(8)
    assert {r.date: r.shifted for r in panel.shift_from(dates, week, -1).collect()} == {day(3): None, day(4): None, day(5): None, day(7): day(4), day(8): day(7), day(9): day(7)}
    days = lambda **k: {r.date for r in panel.days_between(week, "2024-01-05", "2024-01-09", **k).collect()}
    assert days() == {day(4), day(7), day(8)} and days(with_start=False) == {day(7), day(8)} and days(with_start=False, with_end=False) == {day(7)}


def test_cost_models(spark):
    df = spark.createDataFrame([("buy", 10.0, 100.0), ("SELL", 10.0, 100.0), ("b", 0.0, 5.0)], "side string, price double, quantity double")
    cost = {k: [round(r.cost, 6) for r in backtest.trade_costs(df, **v).collect()] for k, v in backtest.COST_MODELS.items()}
    assert cost == {"least_fee": [5.51, 6.51, 0.0], "no_least_fee": [0.81, 1.81, 0.0], "plain": [1.3, 2.3, 0.0], "both_sides": [6.0, 6.0, 0.0]}


def test_long_picks(spark):
    df = spark.createDataFrame([(day(0), f"c{k}", float(k)) for k in range(6)] + [(day(1), "x", None), (day(1), "y", 1.0)], "date date, code string, signal double")
    assert {(r.date, r.code) for r in metrics.long_picks(df).collect()} == {(day(0), "c4"), (day(0), "c5"), (day(1), "y")}


def test_partitions_are_cleared(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("bars", "a b", 1), ("bars", "c", 2), ("ticks", "a b", 3), ("ticks", None, 4)], "dataset string, symbol string, x int")
    tables.write_table(df, path, partition_by=["dataset", "symbol"])
    left = lambda: {r.x for r in spark.read.parquet(path).collect()}
    assert tables.clear(spark, path) == 0 and left() == {1, 2, 3, 4}
    assert tables.clear(spark, path, dataset="bars", symbol="c") == 1 and left() == {1, 3, 4}
    assert tables.clear(spark, path, symbol="a b") == 2 and left() == {4}
    assert tables.clear(spark, path, symbol="none") == 0
    with pytest.raises(ValueError, match="x"):
        tables.clear(spark, path, x=4)


def test_look_ahead_report(spark):
    rows = [("a", day(0), day(0), day(0), day(1), day(2), 0.1), ("a", day(0), day(2), day(1), day(1), day(1), 0.1), ("b", None, None, day(1), day(0), day(0), None)]
    df = spark.createDataFrame(rows, "code string, date date, available_date date, signal_date date, entry_date date, exit_date date, forward_return double")
    got = {r.check: (r["count"], r.severity, r.passed) for r in validate.look_ahead_report(df, lookback=-1).collect()}
    assert {k: v[0] for k, v in got.items()} == {"no_key": 1, "repeated_key": 1, "known_after_signal": 1, "no_known_date": 1, "signal_after_date": 1, "entry_before_signal": 1, "same_day_entry": 1, "exit_not_after_entry": 2, "return_of_no_window": 1, "negative_lookback": 1}
    assert got["same_day_entry"][1:] == ("warning", False) and got["no_key"][1] == "violation"
    few = {r.check: r["count"] for r in validate.look_ahead_report(df.select("date", "available_date"), ("date", "code"), shift=1).collect()}
    assert few == {"missing_code": 1, "known_after_signal": 1, "no_known_date": 1, "negative_shift": 0}
    assert all(r.passed for r in validate.look_ahead_report(df.where("false")).collect())


def test_shortlist_and_plain_means(spark):
    df = spark.createDataFrame([("a", 0.1, 2.0, 1.0), ("b", 0.1, 1.0, 1.0), ("c", None, 2.0, None), ("d", -1.0, 2.0, 1.0)], "code string, momentum double, volume_ratio double, fund_flow double")
    assert {r.code: r.score for r in portfolio.shortlist(df).collect()} == {"a": 100, "b": 70, "d": 70}
    d = spark.createDataFrame([(4.0, -2.0), (0.0, None), (None, 2.0)], "pe double, pb double")
    assert [r[0] for r in d.select(factors.plain_mean(factors.positive_yield("pe"), factors.positive_yield("pb"))).collect()] == [0.25, 0.0, 0.5]


@pytest.mark.parametrize(("n", "size"), [(1, 3), (2, 2), (24, 5), (30, 29)])
def test_tournament_draws_without_putting_back(spark, n, size):
    df = spark.createDataFrame([(f"a{k:02d}", float(k)) for k in range(n)] + [("none", None)], "alpha string, fitness double")
    won = [int(r.fitness) for r in fitness.tournament(df, 300, size, seed=1).collect()]
    # the fittest of `size` different ones is never among the size - 1 worst, and wins in size of n rounds
    assert len(won) == 300 and min(won) >= min(size, n) - 1
    assert won.count(n - 1) == pytest.approx(300 * min(size, n) / n, abs=45)
    assert fitness.tournament(df.where("false"), 3, 2).count() == 0
