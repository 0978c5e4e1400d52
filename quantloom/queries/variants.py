"""Queries of variants: checked forward returns, curve measures, cost models, picks, calendars for want of an exchange's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.num import sdiv
from ..functions.windows import lag, roll_mean
from ..operators import backtest as bt
from ..operators import factors as fa
from ..operators import metrics as me
from ..operators import panel as pn
from ..operators import portfolio as pf
from ..operators import transforms as tr
from ..operators import validate as va
from ..sources import tables as src
from .registry import bars, facts, fills, query, r6, rounded, signals

CHECKED = """f AS (SELECT code, date, lead(date) OVER w AS entry_date, lead(date, 5) OVER w AS exit_date, lead(open) OVER w AS a, lead(close, 5) OVER w AS b FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
    g AS (SELECT code, date, entry_date, exit_date, b / nullif(a, 0) - 1 AS r, coalesce(a > 0 AND b > 0, false) AS ok FROM f)"""


@query(f"WITH {CHECKED} SELECT code, date, entry_date, exit_date, round(r,6)+0.0 AS forward_return, ok AS forward_return_valid FROM g", "bars")
def forward_returns_checked(spark, sf):
    return pn.forward_returns(bars(spark, sf), 5).select("code", "date", "entry_date", "exit_date", r6("forward_return").alias("forward_return"), "forward_return_valid")


@query(f"WITH {CHECKED} SELECT count(*) AS n_rows, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_missing, round(avg(r),6)+0.0 AS mean, round(quantile_cont(r, 0.5),6)+0.0 AS median, round(stddev_samp(r),6)+0.0 AS std, round(min(r),6)+0.0 AS smallest, round(max(r),6)+0.0 AS largest FROM g", "bars")
def forward_return_stats(spark, sf):
    return rounded(pn.forward_return_stats(pn.forward_returns(bars(spark, sf), 5)), "n_rows", "n_valid", "n_missing", **{c: c for c in ("mean", "median", "std", "smallest", "largest")})


def _curve(years: str, std: str, none: str, floor: str) -> str:
    """SQL of a curve's measures; std: the deviation function; none: what is missing; floor: of the losses' deviation."""
    down = f"greatest({std}(r) FILTER (r < 0), {floor})"
    return f"""WITH v AS (SELECT date, avg(close) AS v FROM bars GROUP BY date), x AS (SELECT *, v / lag(v) OVER (ORDER BY date) - 1 AS r, v / max(v) OVER (ORDER BY date) - 1 AS dd FROM v),
    s AS (SELECT count(*) AS n, arg_max(v, date) / arg_min(v, date) - 1 AS total_return, date_diff('day', min(date), max(date)) AS days, avg(r) AS m, {std}(r) AS sd, {down} AS down, count(*) FILTER (r < 0) AS lost, min(dd) AS max_drawdown FROM x),
    t AS (SELECT *, pow(1 + total_return, 1 / ({years})) - 1 AS cagr FROM s),
    u AS (SELECT *, CASE WHEN sd > 0 THEN m / sd * sqrt(252) ELSE {none} END AS sharpe, CASE WHEN lost > 0 AND down > 0 THEN m / down * sqrt(252) ELSE {none} END AS sortino, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE {none} END AS calmar FROM t)
    SELECT n, round(total_return,6)+0.0 AS total_return, round(cagr,6)+0.0 AS cagr, round(sd * sqrt(252),6)+0.0 AS volatility, round(sharpe,6)+0.0 AS sharpe, round(sortino,6)+0.0 AS sortino, round(max_drawdown,6)+0.0 AS max_drawdown, round(calmar,6)+0.0 AS calmar,
    round(cagr * 0.3::DOUBLE + sharpe * 0.25::DOUBLE + sortino * 0.15::DOUBLE + calmar * 0.15::DOUBLE + total_return * 0.15::DOUBLE,6)+0.0 AS score, max_drawdown < -0.15 AS stopped FROM u"""


def _measures(spark, sf, **options):
    """Of the mean close by date, as a curve."""
    found = me.curve_performance(bars(spark, sf).groupBy("date").agg(F.avg("close").alias("equity")), **options)
    return rounded(found, "n", "stopped", **{c: c for c in ("total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "score")})


@query(_curve("greatest(days / 365.25, 1 / 365.25)", "stddev_samp", "NULL", "0"), "bars")
def curve_performance_by_days(spark, sf):
    return _measures(spark, sf)


@query(_curve("greatest(n / 252, 1 / 252)", "stddev_pop", "0", "1e-8"), "bars")
def curve_performance_by_rows(spark, sf):
    return _measures(spark, sf, ddof=0, calendar=False, none=0.0, floor=1e-8)


@query(
    """WITH c AS (SELECT side, abs(price * quantity) AS v FROM fills), f AS (SELECT 'least_fee' AS model, greatest(v * 0.0003::DOUBLE, 5) + CASE WHEN side = 'sell' THEN v * 0.001::DOUBLE ELSE 0 END + v * 0.00001::DOUBLE + v * 0.0005::DOUBLE AS cost FROM c WHERE v > 0
      UNION ALL SELECT 'no_least_fee', v * 0.0003::DOUBLE + CASE WHEN side = 'sell' THEN v * 0.001::DOUBLE ELSE 0 END + v * 0.00001::DOUBLE + v * 0.0005::DOUBLE FROM c
      UNION ALL SELECT 'plain', v * 0.0003::DOUBLE + CASE WHEN side = 'sell' THEN v * 0.001::DOUBLE ELSE 0 END + v * 0.001::DOUBLE FROM c UNION ALL SELECT 'both_sides', greatest(v * 0.0003::DOUBLE, 5) + v * 0.001::DOUBLE FROM c WHERE v > 0)
    SELECT model, count(*) AS n, round(sum(cost),2)+0.0 AS cost, round(avg(cost),6)+0.0 AS mean_cost, round(max(cost),6)+0.0 AS largest FROM f GROUP BY model""",
    "fills",
)
def trade_cost_models(spark, sf):
    out = None
    for name, options in bt.COST_MODELS.items():
        one = bt.trade_costs(fills(spark, sf), **options).select(F.lit(name).alias("model"), "cost")
        out = one if out is None else out.unionAll(one)
    return out.groupBy("model").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("cost"), 2) + 0.0).alias("cost"), r6(F.avg("cost")).alias("mean_cost"), r6(F.max("cost")).alias("largest"))


@query("SELECT date, code, round(signal,6)+0.0 AS signal, round(cut,6)+0.0 AS cut FROM (SELECT *, quantile_cont(signal, 0.8) OVER (PARTITION BY date) AS cut FROM signals) WHERE signal >= cut", "signals")
def long_quantile_picks(spark, sf):
    return rounded(me.long_picks(signals(spark, sf)), "date", "code", signal="signal", cut="cut")


@query("SELECT code, date, round(CASE WHEN volume IS NOT NULL AND stddev_pop(volume) OVER w > 0 THEN (volume - avg(volume) OVER w) / stddev_pop(volume) OVER w END,6)+0.0 AS z FROM bars WINDOW w AS (PARTITION BY date)", "bars")
def zscore_null_when_flat(spark, sf):
    return rounded(bars(spark, sf), "code", "date", z=tr.zscore("volume", None, 0.0))


@query("SELECT CAST(d AS DATE) AS date, CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS ordinal FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders) WHERE isodow(d) <= 5")
def weekday_calendar(spark, sf):
    first, last = src.table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    return pn.weekday_calendar(spark, str(first), str(last))


@query(
    """WITH c AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
    n AS (SELECT d.date, min(c.i) AS i FROM d LEFT JOIN c ON c.date >= d.date GROUP BY d.date), p AS (SELECT d.date, max(c.i) AS i FROM d LEFT JOIN c ON c.date <= d.date GROUP BY d.date)
    SELECT n.date, a.date AS forward, b.date AS back FROM n JOIN p USING (date) LEFT JOIN c a ON a.i = n.i + 2 LEFT JOIN c b ON b.i = p.i - 2""",
    "bars",
)
def calendar_shift_from_any_day(spark, sf):
    """Two trading days on from each order's date, and two back; days without trade count from the nearest day in that direction."""
    days = pn.calendar(bars(spark, sf))
    dates = src.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    forward, back = pn.shift_from(dates, days, 2).withColumnRenamed("shifted", "forward"), pn.shift_from(dates, days, -2).withColumnRenamed("shifted", "back")
    return forward.join(back, "date")


@query("SELECT DISTINCT date FROM bars WHERE date > DATE '1996-01-01' AND date <= DATE '1996-12-30'", "bars")
def calendar_range(spark, sf):
    return pn.days_between(pn.calendar(bars(spark, sf)), "1996-01-01", "1996-12-30", with_start=False).select("date")


_AUDIT = {
    "no_key": ("violation", "count(*) FILTER (date IS NULL OR code IS NULL)"), "repeated_key": ("violation", "count(*) - count(DISTINCT (date, code))"),
    "known_after_signal": ("violation", "count(*) FILTER (available_date > signal_date)"), "no_known_date": ("warning", "count(*) FILTER (available_date IS NULL)"),
    "signal_after_date": ("violation", "count(*) FILTER (signal_date > date)"), "entry_before_signal": ("violation", "count(*) FILTER (entry_date < signal_date)"),
    "same_day_entry": ("warning", "count(*) FILTER (entry_date = signal_date)"), "exit_not_after_entry": ("violation", "count(*) FILTER (exit_date <= entry_date)"),
    "return_of_no_window": ("violation", "count(*) FILTER (exit_date <= entry_date AND forward_return IS NOT NULL)"), "negative_lookback": ("violation", "0"), "negative_shift": ("violation", "1"),
}


@query(
    """WITH l AS (SELECT code, report_period AS date, available_date, report_period - CAST(fact_id % 3 AS INT) + 1 AS signal_date, CASE WHEN fact_id % 7 <> 0 THEN report_period + CAST(fact_id % 4 AS INT) END AS entry_date,
      report_period + CAST(fact_id % 6 AS INT) AS exit_date, CASE WHEN fact_id % 5 <> 0 THEN roe END AS forward_return FROM facts), c AS ("""
    + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", '{kind}' AS severity, CAST({n} AS BIGINT) AS count FROM l" for k, (kind, n) in _AUDIT.items())
    + ') SELECT DISTINCT "check", severity, count, count = 0 AS passed FROM c',
    "facts",
)
def lookahead_report(spark, sf):
    k, day = F.col("fact_id"), F.col("report_period")
    f = facts(spark, sf).select(
        "code", day.alias("date"), "available_date", F.date_add(day, (1 - k % 3).cast("int")).alias("signal_date"), F.when(k % 7 != 0, F.date_add(day, (k % 4).cast("int"))).alias("entry_date"),
        F.date_add(day, (k % 6).cast("int")).alias("exit_date"), F.when(k % 5 != 0, F.col("roe")).alias("forward_return"),
    )
    return va.look_ahead_report(f, lookback=20, shift=-1)


@query(
    """WITH s AS (SELECT code, date, close / nullif(lag(close) OVER w, 0) - 1 AS momentum, CASE WHEN count(volume) OVER v >= 20 THEN volume / nullif(avg(volume) OVER v, 0) END AS volume_ratio, close - open AS fund_flow
      FROM bars WINDOW w AS (PARTITION BY code ORDER BY date), v AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    p AS (SELECT code, date, CAST(CASE WHEN momentum > 0 THEN 30 ELSE 0 END + CASE WHEN volume_ratio > 1.5 THEN 30 ELSE 0 END + CASE WHEN fund_flow > 0 THEN 40 ELSE 0 END AS INT) AS score FROM s) SELECT * FROM p WHERE score >= 70""",
    "bars",
)
def scanner_shortlist(spark, sf):
    s = bars(spark, sf).select("code", "date", (sdiv("close", lag("close")) - 1).alias("momentum"), sdiv("volume", roll_mean("volume", 20)).alias("volume_ratio"), (F.col("close") - F.col("open")).alias("fund_flow"))
    return pf.shortlist(s).select("code", "date", F.col("score").cast("int").alias("score"))


@query(
    """SELECT fact_id, round(coalesce(list_avg(list_filter([1 / CASE WHEN pe > 0 THEN pe END, 1 / CASE WHEN pb > 0 THEN pb END, 1 / CASE WHEN ps > 0 THEN ps END], lambda x: x IS NOT NULL)), 0),6)+0.0 AS value,
    round(coalesce(list_avg(list_filter([roe, roic, revenue_growth, profit_growth], lambda x: x IS NOT NULL)), 0),6)+0.0 AS quality FROM facts""",
    "facts",
)
def plain_composites(spark, sf):
    value = fa.plain_mean(*[fa.positive_yield(c) for c in ("pe", "pb", "ps")])
    return rounded(facts(spark, sf), "fact_id", value=value, quality=fa.plain_mean("roe", "roic", "revenue_growth", "profit_growth"))


@query(
    """SELECT code, date, round(coalesce(signal, avg(signal) OVER w),6)+0.0 AS by_mean, round(coalesce(signal, 0),6)+0.0 AS by_zero,
    round(CASE WHEN signal IS NOT NULL THEN (rank() OVER (PARTITION BY date, signal IS NULL ORDER BY signal) + (count(*) OVER (PARTITION BY date, signal) - 1) / 2) / count(signal) OVER w - 0.5 END,6)+0.0 AS centered FROM signals WINDOW w AS (PARTITION BY date)""",
    "signals",
)
def fill_and_center(spark, sf):
    return rounded(signals(spark, sf), "code", "date", by_mean=tr.fill("signal", "mean"), by_zero=tr.fill("signal", "zero"), centered=tr.rank("signal", True))
