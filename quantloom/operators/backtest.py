"""Costs, set-based backtests, and simulations whose cash and holdings depend on every step before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import col, sdiv
from . import metrics


def side(x: str | Column = "side") -> Column:
    """buy or sell from buy, sell, b, s in any case; else null."""
    s = F.lower(F.trim(col(x)))
    return F.when(s.isin("buy", "b"), "buy").when(s.isin("sell", "s"), "sell")


# Rates and least fees of the cost models (fixed values).
COST_MODELS = {
    "least_fee": {},
    "no_least_fee": {"least": 0.0},
    "plain": {"least": 0.0, "transfer": 0.0, "slippage": 0.001},
    "both_sides": {"transfer": 0.0, "slippage": 0.0, "stamp_on": ("buy", "sell")},
}


def trade_costs(trades: DataFrame, commission: float = 0.0003, least: float = 5.0, stamp: float = 0.001, transfer: float = 0.00001, slippage: float = 0.0005, stamp_on: tuple[str, ...] = ("sell",)) -> DataFrame:
    """trades with value, commission (at least `least`), stamp duty on the sides `stamp_on`, transfer fee, slippage and cost. COST_MODELS has the options of known models."""
    value = F.abs(F.col("price") * F.col("quantity"))
    out = trades.withColumns({"side": side(), "value": value}).withColumns({
        "commission": F.when(F.col("value") > 0, F.greatest(F.col("value") * commission, F.lit(least))).otherwise(0.0),
        "stamp": F.when(F.col("side").isin(*stamp_on), F.col("value") * stamp).otherwise(0.0),
        "transfer": F.col("value") * transfer,
        "slippage": F.col("value") * slippage,
    })
    return out.withColumn("cost", F.col("commission") + F.col("stamp") + F.col("transfer") + F.col("slippage"))


def cost_summary(costs: DataFrame) -> DataFrame:
    total = [F.sum(c).alias(c) for c in ("value", "commission", "stamp", "transfer", "slippage", "cost")]
    return costs.agg(F.count(F.lit(1)).alias("n_trades"), *total, sdiv(F.sum("cost"), F.sum("value")).alias("cost_rate"))


def turnover_cost(turnover: str | Column, buy: float = 0.0008, sell: float = 0.0018) -> Column:
    """Of a day whose holdings turn over by that share: sold and bought."""
    return col(turnover) * (buy + sell)


def impact(value: str | Column, volume: str | Column, rate: float = 0.1) -> Column:
    """Square-root market impact of a trade's share of the volume."""
    return F.lit(rate) * F.sqrt(F.coalesce(sdiv(value, volume), F.lit(0.0)))


def long_only(df: DataFrame, q: int = 5, x: str = "signal", y: str = "fwd") -> DataFrame:
    """date, ret: the mean return of the top quantile; with equity and drawdown."""
    top = metrics.quantile_returns(df, q, True, x, y).select("date", F.col(f"q{q}").alias("ret"))
    return metrics.equity(top.where("ret IS NOT NULL"))


def daily(df: DataFrame, q: int = 5, x: str = "signal", y: str = "fwd") -> DataFrame:
    """date, n, rank_ic, q1, qn, spread, turnover, cost, net: a signal's cross-sectional backtest, each date an aggregate of its rows."""
    ranks = metrics.ic(df, x, y, ranks=True).select("date", "n", F.col("ic").alias("rank_ic"))
    means = metrics.quantile_returns(df, q, True, x, y).select("date", "q1", f"q{q}", (F.col(f"q{q}") - F.col("q1")).alias("spread"))
    both = df.where(col(x).isNotNull() & col(y).isNotNull())
    marked = both.withColumn("__q", metrics.quantile_by_cut(x, q)).where(F.col("__q") == q)
    held = marked.groupBy("date").agg(F.collect_set("code").alias("held"))  # a date's top codes
    turned = metrics.turnover_overlap(held)
    out = ranks.join(means, "date", "left").join(turned, "date", "left")
    cost = turnover_cost("turnover")
    return out.withColumns({"cost": cost, "net": F.col(f"q{q}") - cost})


def summarize(days: DataFrame, q: int = 5) -> DataFrame:
    """One row of daily()."""
    c = F.col("rank_ic")
    return days.agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(c).alias("rank_ic_mean"), sdiv(F.avg(c), F.stddev_samp(c)).alias("rank_ic_ir"), F.avg("q1").alias("q1_mean"), F.avg(f"q{q}").alias("top_mean"),
        F.avg("spread").alias("spread_mean"), sdiv(F.count_if(F.col("spread") > 0), F.count("spread")).alias("spread_positive"), F.avg("turnover").alias("turnover_mean"), F.avg("net").alias("net_mean"),
    )


def full_summary(days: DataFrame, q: int = 5, year: float = 252.0) -> DataFrame:
    """One row of daily(): correlations, quantiles, costs, and the top quantile's returns before and after costs; passed: some rows and correlations."""
    c, net = F.col("rank_ic"), F.col("net")
    curve = metrics.equity(days.select("date", net.alias("ret"))).select("date", "drawdown", F.col("equity").alias("__e"))
    n = F.count(net)
    grown = lambda x: F.product(1 + F.coalesce(col(x), F.lit(0.0))) - 1
    out = days.join(curve, "date").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("n").alias("n_observations"), F.avg(c).alias("ic_mean"), F.stddev_samp(c).alias("ic_std"), sdiv(F.avg(c), F.stddev_samp(c)).alias("icir"),
        sdiv(F.count_if(c > 0), F.count(c)).alias("positive_ic_ratio"), F.avg(f"q{q}").alias("top_mean"), F.avg("q1").alias("q1_mean"), F.avg("spread").alias("spread_mean"), F.avg("turnover").alias("average_turnover"),
        F.sum("cost").alias("total_cost"), grown(f"q{q}").alias("cumulative_gross"), grown("net").alias("cumulative_net"), (F.stddev_samp(net) * F.sqrt(F.lit(year))).alias("annual_volatility"),
        (sdiv(F.avg(net), F.stddev_samp(net)) * F.sqrt(F.lit(year))).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), n.alias("__n"), F.count(c).alias("__c"),
    )
    out = out.withColumn("annual_return", F.pow(1 + F.col("cumulative_net"), F.lit(year) / F.col("__n")) - 1)
    return out.withColumn("passed", (F.coalesce("n_observations", F.lit(0)) > 0) & (F.col("__c") > 0)).drop("__n", "__c")


def rotation(df: DataFrame, n: int = 5, buy: float = 0.0008, sell: float = 0.0018, x: str = "signal", y: str = "fwd") -> DataFrame:
    """date, ret, buys, sells, cost, net, equity, drawdown: the n greatest signals held in equal parts, the changes paid for."""
    known = df.where(col(x).isNotNull() & col(y).isNotNull())
    w = Window.partitionBy("date").orderBy(F.desc(x), "code")
    top = known.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    held = top.groupBy("date").agg(F.collect_set("code").alias("held"), F.avg(y).alias("ret"))
    before = F.coalesce(F.lag("held").over(Window.orderBy("date")), F.array().cast("array<string>"))  # a row a date
    changed = held.withColumns({"buys": F.size(F.array_except("held", before)), "sells": F.size(F.array_except(before, "held"))})
    paid = changed.withColumn("cost", (F.col("buys") * buy + F.col("sells") * sell) / float(n)).withColumn("net", F.col("ret") - F.col("cost"))
    return metrics.equity(paid.drop("held"), "net")


def rebalance(prices: DataFrame, targets: DataFrame, cash: float = 1e6, commission: float = 0.0003, stamp: float = 0.001, slippage: float = 0.0005, lot: int = 100, strategy: str = "strategy") -> DataFrame:
    """strategy, date, equity, cash, traded: holdings set to target weights on their dates, sales first, in whole lots and with costs.

    prices(strategy, date, code, price), targets(strategy, date, code, weight). Cash and lots depend on all steps before, so a strategy
    is one group of rows; strategies run side by side.
    """

    def run(key: tuple, group: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        price = group.pivot_table(index="date", columns="code", values="price", aggfunc="last").sort_index().ffill()
        weight = {d: g.set_index("code")["weight"] for d, g in wanted.groupby("date")}
        have, money, rows = pd.Series(0.0, index=price.columns), cash, []
        for d, p in price.iterrows():
            traded = 0.0
            if d in weight:
                worth = money + float((have * p).sum())
                want = (weight[d].reindex(price.columns).fillna(0.0) * worth / p / lot).apply(np.floor).fillna(0.0) * lot
                for code, n in (want - have).sort_values().items():  # sales come first
                    if n < 0:
                        value = -n * p[code] * (1 - slippage)
                        money += value * (1 - commission - stamp)
                    elif n > 0:
                        cost = p[code] * (1 + slippage) * (1 + commission)
                        n = min(n, np.floor(money / cost / lot) * lot)
                        value = n * p[code] * (1 + slippage)
                        money -= n * cost
                    else:
                        continue
                    have[code] += n
                    traded += value
            rows.append((key[0], d, money + float((have * p).sum()), money, traded))
        return pd.DataFrame(rows, columns=[strategy, "date", "equity", "cash", "traded"])

    kind = prices.schema[strategy].dataType.simpleString()
    # both sides renamed, so that they may come from one table
    a, b = (df.select(*[F.col(c).alias(c) for c in df.columns]).toDF(*df.columns) for df in (prices, targets))
    return a.groupBy(strategy).cogroup(b.groupBy(strategy)).applyInPandas(run, f"`{strategy}` {kind}, date date, equity double, cash double, traded double")


def signal_trades(panel: DataFrame, cash: float = 1e5, lot: int = 100, commission: float = 0.0003, stamp: float = 0.001) -> DataFrame:
    """code, date, position, cash, equity: all in at a positive signal, all out at a negative one, at the close of the row after it.

    A code's rows are one group; codes run side by side.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        act = group["signal"].shift(1).fillna(0.0).to_numpy()
        price = group["close"].to_numpy()
        have, money, rows = 0.0, cash, []
        for a, p in zip(act, price, strict=True):
            if a > 0 and not have and p > 0:
                have = np.floor(money / (p * (1 + commission)) / lot) * lot
                money -= have * p * (1 + commission)
            elif a < 0 and have:
                money += have * p * (1 - commission - stamp)
                have = 0.0
            rows.append((have, money, money + have * p))
        return pd.DataFrame(rows, columns=["position", "cash", "equity"], index=group.index).assign(code=group["code"], date=group["date"])[["code", "date", "position", "cash", "equity"]]

    return panel.select("code", "date", "close", "signal").groupBy("code").applyInPandas(run, "code string, date date, position double, cash double, equity double")
