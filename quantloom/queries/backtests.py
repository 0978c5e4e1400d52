"""Backtest, cost and portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as op
from ..operators import metrics as me
from ..operators import portfolio as pf
from .registry import bars, fills, query, r6, rounded, signals
from .signals import BY_CUT, CORR, PAIRS, RANKED

D = "OVER (PARTITION BY date)"
Q5 = f"{PAIRS}, q AS (SELECT date, code, fwd, {BY_CUT} AS q FROM p)"
COST = "0.0026::DOUBLE"
DAILY = f"""{RANKED}, d AS (SELECT date, count(*) AS n, {CORR.format('a', 'b')} AS ic, count(*) >= 5 AS ok FROM k GROUP BY date), q AS (SELECT date, code, fwd, {BY_CUT} AS q FROM p),
m AS (SELECT date, avg(fwd) FILTER (q = 1) AS q1, avg(fwd) FILTER (q = 5) AS q5 FROM q GROUP BY date), h AS (SELECT date, list(code) AS held FROM q WHERE q = 5 GROUP BY date),
t AS (SELECT date, 1 - len(list_intersect(held, coalesce(lag(held) OVER (ORDER BY date), []))) / len(held) AS turnover FROM h),
r AS (SELECT d.date, n, CASE WHEN ok THEN ic END AS rank_ic, q1, q5, q5 - q1 AS spread, turnover, turnover * {COST} AS cost, q5 - turnover * {COST} AS net FROM d LEFT JOIN m USING (date) LEFT JOIN t USING (date))"""


@query(f"WITH {DAILY} SELECT date, n, round(rank_ic,6)+0.0 AS rank_ic, round(spread,6)+0.0 AS spread, round(turnover,6)+0.0 AS turnover, round(net,6)+0.0 AS net FROM r", "signals")
def alpha_backtest_daily(spark, sf):
    return rounded(op.daily(signals(spark, sf)), "date", "n", rank_ic="rank_ic", spread="spread", turnover="turnover", net="net")


@query(
    f"""WITH {DAILY} SELECT count(*) AS n_days, round(avg(rank_ic),6)+0.0 AS rank_ic_mean, round(avg(q1),6)+0.0 AS q1_mean, round(avg(q5),6)+0.0 AS top_mean, round(avg(spread),6)+0.0 AS spread_mean,
    round(count(*) FILTER (spread > 0) / count(spread),6)+0.0 AS spread_positive, round(avg(turnover),6)+0.0 AS turnover_mean, round(avg(net),6)+0.0 AS net_mean FROM r""",
    "signals",
)
def alpha_backtest_summary(spark, sf):
    return rounded(op.summarize(op.daily(signals(spark, sf))), "n_days", **{c: c for c in ("rank_ic_mean", "q1_mean", "top_mean", "spread_mean", "spread_positive", "turnover_mean", "net_mean")})


FULL = {
    "ic_mean": "avg(rank_ic)", "ic_std": "stddev_samp(rank_ic)", "icir": "avg(rank_ic) / nullif(stddev_samp(rank_ic), 0)", "positive_ic_ratio": "count(*) FILTER (rank_ic > 0) / count(rank_ic)", "top_mean": "avg(q5)", "q1_mean": "avg(q1)",
    "spread_mean": "avg(spread)", "average_turnover": "avg(turnover)", "total_cost": "sum(cost)", "cumulative_gross": "sum(ln(1 + coalesce(q5, 0)))", "cumulative_net": "sum(ln(1 + coalesce(net, 0)))",
    "annual_volatility": "stddev_samp(net) * sqrt(252)", "sharpe": "avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)", "max_drawdown": "min(e / greatest(1, m) - 1)", "annual_return": "sum(ln(1 + coalesce(net, 0))) * 252 / count(net)",
}


@query(
    f"""WITH {DAILY}, x AS (SELECT *, exp(sum(ln(1 + coalesce(net, 0))) OVER (ORDER BY date)) AS e FROM r), y AS (SELECT *, max(e) OVER (ORDER BY date) AS m FROM x)
    SELECT count(*) AS n_days, CAST(sum(n) AS BIGINT) AS n_observations, {", ".join(f"round({v},6)+0.0 AS {k}" for k, v in FULL.items())}, sum(n) > 0 AND count(rank_ic) > 0 AS passed FROM y""",
    "signals",
)
def alpha_backtest_full_summary(spark, sf):
    """Growth as its logarithm, as these returns grow beyond what rounding to places can compare."""
    out = op.full_summary(op.daily(signals(spark, sf)))
    return rounded(out, "n_days", "n_observations", "passed", **{c: F.log1p(c) if c.startswith("cumulative") or c == "annual_return" else c for c in FULL})


@query(f"WITH {Q5}, m AS (SELECT date, avg(fwd) AS ret FROM q WHERE q = 5 GROUP BY date), e AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS equity FROM m) SELECT date, round(ret,6)+0.0 AS ret, round(equity / greatest(1, max(equity) OVER (ORDER BY date)) - 1,6)+0.0 AS drawdown FROM e", "signals")
def long_only_quantile(spark, sf):
    return rounded(op.long_only(signals(spark, sf)), "date", ret="ret", drawdown="drawdown")


@query(
    f"""WITH {PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal DESC, code) AS k FROM p), h AS (SELECT date, list(code) AS held, avg(fwd) AS ret FROM t WHERE k <= 5 GROUP BY date),
    l AS (SELECT *, coalesce(lag(held) OVER (ORDER BY date), []) AS before FROM h), c AS (SELECT date, ret, len(held) - len(list_intersect(held, before)) AS buys, len(before) - len(list_intersect(held, before)) AS sells FROM l)
    SELECT date, CAST(buys AS INT) AS buys, CAST(sells AS INT) AS sells, round(ret,6)+0.0 AS ret, round(ret - (buys * 0.0008::DOUBLE + sells * 0.0018::DOUBLE) / 5,6)+0.0 AS net FROM c""",
    "signals",
)
def topn_rotation(spark, sf):
    return rounded(op.rotation(signals(spark, sf)), "date", "buys", "sells", ret="ret", net="net")


COSTS = """c AS (SELECT *, abs(price * quantity) AS value FROM fills), f AS (SELECT *, CASE WHEN value > 0 THEN greatest(value * 0.0003::DOUBLE, 5) ELSE 0 END AS commission, CASE WHEN side = 'sell' THEN value * 0.001::DOUBLE ELSE 0 END AS stamp, value * 0.00001::DOUBLE AS transfer, value * 0.0005::DOUBLE AS slippage FROM c)"""


@query(f"WITH {COSTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, side, round(value,8)+0.0 AS value, round(commission + stamp + transfer + slippage,8)+0.0 AS cost FROM f", "fills")
def trade_costs(spark, sf):
    return op.trade_costs(fills(spark, sf)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "side", *[(F.round(c, 8) + 0.0).alias(c) for c in ("value", "cost")])


@query(f"WITH {COSTS} SELECT count(*) AS n_trades, round(sum(stamp),2)+0.0 AS stamp, round(sum(commission),2)+0.0 AS commission, round(sum(commission + stamp + transfer + slippage) / sum(value),6)+0.0 AS cost_rate FROM f", "fills")
def cost_summary(spark, sf):
    return op.cost_summary(op.trade_costs(fills(spark, sf))).select("n_trades", *[(F.round(c, 2) + 0.0).alias(c) for c in ("stamp", "commission")], r6("cost_rate").alias("cost_rate"))


def _strategies(spark, sf):
    b = bars(spark, sf).where("close > 0")
    prices = b.select(F.col("industry").alias("strategy"), "date", "code", F.col("close").alias("price"))
    first = b.where("day(date) <= 7").select(F.col("industry").alias("strategy"), "date", "code", (F.lit(0.9) / F.count(F.lit(1)).over(me.Window.partitionBy("industry", "date"))).alias("weight"))
    return prices, first


@query()
def target_weight_rebalance(spark, sf):
    return op.rebalance(*_strategies(spark, sf), cash=1e8)


@query()
def signal_backtest(spark, sf):
    s = signals(spark, sf).select("code", "date", F.coalesce("signal", F.lit(0.0)).alias("signal"))
    return op.signal_trades(bars(spark, sf).select("code", "date", "close").join(s, ["code", "date"]), cash=1e7)


RETS = "r AS (SELECT date, code, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM bars)"


@query(f"WITH {RETS} SELECT a.code AS a, b.code AS b, round(covar_samp(a.ret, b.ret) * 252,6)+0.0 AS cov FROM r a JOIN r b USING (date) WHERE a.code <= b.code AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.code, b.code", "bars")
def covariance(spark, sf):
    return rounded(me.covariance(me.code_return(bars(spark, sf))), "a", "b", cov="cov")


@query(
    f"""WITH {RETS}, c AS (SELECT a.code AS a, b.code AS b, covar_samp(a.ret, b.ret) * 252 AS cov FROM r a JOIN r b USING (date) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.code, b.code),
    n AS (SELECT count(DISTINCT code) AS n FROM bars) SELECT round(sqrt(sum(cov / n / n)),6)+0.0 AS volatility FROM c, n""",
    "bars",
)
def portfolio_volatility(spark, sf):
    b = bars(spark, sf)
    codes = b.select("code").distinct()
    w = codes.withColumn("weight", 1.0 / F.count(F.lit(1)).over(me.Window.partitionBy()))  # a row a code
    return rounded(me.portfolio_volatility(me.covariance(me.code_return(b)), w), volatility="volatility")


@query(f"WITH {RETS}, v AS (SELECT code, stddev_samp(ret) AS s FROM r GROUP BY code) SELECT code, round(s,6)+0.0 AS volatility, round((1 / s) / sum(1 / s) OVER (),6)+0.0 AS weight FROM v", "bars")
def inverse_vol_weights(spark, sf):
    return rounded(pf.inverse_volatility(me.code_return(bars(spark, sf))), "code", volatility="volatility", weight="weight")


CAPPED = "w AS (SELECT date, code, industry, close, least(coalesce(amount / nullif(sum(amount) OVER (PARTITION BY date), 0), 0), 0.06::DOUBLE) AS weight FROM bars)"


@query(f"WITH {CAPPED} SELECT date, code, round(CASE WHEN sum(weight) OVER i > 0.2::DOUBLE THEN weight * 0.2::DOUBLE / sum(weight) OVER i ELSE weight END,6)+0.0 AS weight FROM w WINDOW i AS (PARTITION BY date, industry)", "bars")
def industry_budget(spark, sf):
    return rounded(pf.industry_budget(pf.capped_weights(bars(spark, sf), "amount", 0.06), 0.2), "date", "code", weight="weight")


@query(f"WITH {CAPPED} SELECT date, round(sum(weight * weight),6)+0.0 AS hhi, round(max(weight),6)+0.0 AS largest, round(sum(weight),6)+0.0 AS invested FROM w GROUP BY date", "bars")
def concentration(spark, sf):
    return rounded(pf.concentration(pf.capped_weights(bars(spark, sf), "amount", 0.06)), "date", hhi="hhi", largest="largest", invested="invested")


@query(f"WITH {CAPPED} SELECT date, code, CAST(floor(weight * 1e9 / close / 100) * 100 AS BIGINT) AS shares FROM w WHERE close > 0", "bars")
def position_sizing(spark, sf):
    return pf.positions(pf.capped_weights(bars(spark, sf), "amount", 0.06).where("close > 0"), 1e9).select("date", "code", "shares")


@query(
    f"""WITH {RETS}, m AS (SELECT date, avg(ret) AS market FROM r GROUP BY date), b AS (SELECT code, covar_samp(ret, market) / var_samp(market) AS beta FROM r JOIN m USING (date) WHERE ret IS NOT NULL AND market IS NOT NULL GROUP BY code)
    SELECT code, round(beta,6)+0.0 AS beta, round(CASE WHEN beta > 1 THEN 1 / beta ELSE 1 END,6)+0.0 AS scale FROM b""",
    "bars",
)
def beta_scale(spark, sf):
    r = me.code_return(bars(spark, sf))
    return rounded(pf.beta_scale(pf.beta(r, r.groupBy("date").agg(F.avg("ret").alias("market")))), "code", beta="beta", scale="scale")


@query(
    f"""WITH {CAPPED}, a AS (SELECT code, weight FROM w WHERE date = (SELECT min(date) FROM w WHERE date >= DATE '1998-01-01')), b AS (SELECT code, weight FROM w WHERE date = (SELECT min(date) FROM w WHERE date >= DATE '1999-01-01')),
    j AS (SELECT coalesce(a.code, b.code) AS code, coalesce(a.weight, 0) AS held, coalesce(b.weight, 0) AS wanted FROM a FULL JOIN b ON a.code = b.code)
    SELECT code, round(wanted - held,6)+0.0 AS change, CASE WHEN wanted > held THEN 'buy' ELSE 'sell' END AS side FROM j WHERE abs(wanted - held) >= 0.002::DOUBLE""",
    "bars",
)
def rebalance_orders(spark, sf):
    w = pf.capped_weights(bars(spark, sf), "amount", 0.06)

    def since(day: str):
        return w.join(w.where(F.col("date") >= day).agg(F.min("date").alias("date")), "date").select("code", "weight")

    return rounded(pf.orders(since("1998-01-01"), since("1999-01-01"), 0.002), "code", "side", change="change")


@query()
def minimum_variance(spark, sf):
    r = me.code_return(bars(spark, sf)).withColumn("period", F.year("date"))
    return pf.minimum_variance(r)
