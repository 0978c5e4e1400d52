"""Weights, budgets, orders, and the scores of scans and reviews."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import col, lots, sdiv
from ..functions.windows import by_date
from . import linear


def inverse_volatility(rets: DataFrame) -> DataFrame:
    """code, volatility, weight: weights in inverse proportion to the returns' deviation."""
    by = rets.groupBy("code").agg(F.stddev_samp("ret").alias("volatility"))
    inv = sdiv(F.lit(1.0), "volatility")
    return by.withColumn("__i", inv).withColumn("weight", sdiv("__i", F.sum("__i").over(Window.partitionBy()))).drop("__i")  # a row a code


def capped_weights(df: DataFrame, x: str, cap: float, group: str = "date") -> DataFrame:
    """df with `weight`: x (none below 0) in proportion, none above the cap; the rest stays in cash."""
    pos = F.greatest(col(x), F.lit(0.0))
    return df.withColumn("weight", F.least(F.coalesce(sdiv(pos, F.sum(pos).over(Window.partitionBy(group))), F.lit(0.0)), F.lit(cap)))


def industry_budget(weights: DataFrame, budget: float, industry: str = "industry", group: str = "date") -> DataFrame:
    """weights scaled down where an industry's sum is above its budget."""
    total = F.sum("weight").over(Window.partitionBy(group, industry))
    return weights.withColumn("weight", F.when(total > budget, F.col("weight") * sdiv(F.lit(budget), total)).otherwise(F.col("weight")))


def beta(rets: DataFrame, market: DataFrame, pop_var: bool = False) -> DataFrame:
    """code, beta: covariance with the market's returns(date, market) over its variance (of the population by choice)."""
    var = F.var_pop("market") if pop_var else F.var_samp("market")
    return rets.join(market, "date").where("ret IS NOT NULL AND market IS NOT NULL").groupBy("code").agg(sdiv(F.covar_samp("ret", "market"), var).alias("beta"))


def beta_scale(betas: DataFrame, target: float = 1.0) -> DataFrame:
    """code, beta, scale: what a position is multiplied by so that its beta is no more than the target."""
    return betas.withColumn("scale", F.when(F.col("beta") > target, sdiv(F.lit(target), "beta")).otherwise(1.0))


def volatility_scale(vol: str | Column, target: float = 0.15, most: float = 1.0) -> Column:
    return F.least(F.coalesce(sdiv(F.lit(target), vol), F.lit(most)), F.lit(most))


def drawdown_scale(dd: str | Column) -> Column:
    """1 above -5 percent, then 0.7, 0.4 and, below -20 percent, 0."""
    return F.when(col(dd) > -0.05, 1.0).when(col(dd) > -0.10, 0.7).when(col(dd) > -0.20, 0.4).otherwise(0.0)


def orders(held: DataFrame, wanted: DataFrame, least: float = 0.02) -> DataFrame:
    """code, held, wanted, change, side: the changes of at least `least`."""
    both = held.select("code", F.col("weight").alias("held")).join(wanted.select("code", F.col("weight").alias("wanted")), "code", "full_outer").na.fill(0.0, ["held", "wanted"])
    moved = both.withColumn("change", F.col("wanted") - F.col("held")).where(F.abs("change") >= least)
    return moved.withColumn("side", F.when(F.col("change") > 0, "buy").otherwise("sell"))


def positions(df: DataFrame, capital: float, lot: int = 100) -> DataFrame:
    """df with shares in whole lots for its weight of the capital, and their value."""
    return df.withColumn("shares", lots(F.col("weight") * capital, "close", lot)).withColumn("value", F.col("shares") * F.col("close"))


def concentration(weights: DataFrame, group: str = "date") -> DataFrame:
    return weights.groupBy(group).agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.max("weight").alias("largest"), F.sum("weight").alias("invested"))


def minimum_variance(rets: DataFrame, ridge: float = 1e-6, key: str = "period", dense: int = linear.DENSE) -> DataFrame:
    """key, code, weight: weights of least variance that sum to 1, from each period's covariance over the dates that have all of its codes."""
    p = linear.periods(rets, key)
    found = linear.solved(p, {k: np.ones(len(c)) for k, c in p.codes.items()}, ridge, dense)
    return linear.weights_table(rets, p, {k: w / w.sum() for k, w in found.items()})


def risk_parity(rets: DataFrame, most: float = 0.2) -> DataFrame:
    """code, weight: in inverse proportion to volatility (of a variance of 1e-8 at least), none above `most`, then made to sum to 1 again."""
    inv = sdiv(F.lit(1.0), F.sqrt(F.greatest(F.var_samp("ret"), F.lit(1e-8))))
    by = rets.groupBy("code").agg(inv.alias("i")).where("i IS NOT NULL")
    whole = Window.partitionBy()  # a row a code
    capped = by.select("code", F.least(sdiv("i", F.sum("i").over(whole)), F.lit(most)).alias("w"))
    return capped.select("code", sdiv("w", F.sum("w").over(whole)).alias("weight"))


def mean_variance(rets: DataFrame, expected: DataFrame | None = None, most: float = 1.0, key: str = "period", dense: int = linear.DENSE) -> DataFrame:
    """key, code, weight: the inverse covariance times expected(key, code, mu) (else mean returns), none below 0 or above `most`, summing to 1.

    Dates without a return of one of the period's codes are left out.
    """
    p = linear.periods(rets, key)
    told = {(r[0], r[1]): r[2] for r in expected.where("mu IS NOT NULL").select(key, "code", "mu").collect()} if expected is not None else {}  # a number a code and period
    mu = {k: np.array([told.get((k, c), m) for c, m in zip(p.codes[k], p.means[k], strict=True)]) for k in p.means}
    out = {}
    for k, w in linear.solved(p, mu, 1e-8, dense).items():
        raw = np.maximum(w, 0)
        raw = raw if raw.sum() > 0 else np.ones(len(raw))
        w = np.minimum(raw / raw.sum(), most)
        out[k] = w / w.sum()
    return linear.weights_table(rets, p, out)


def posterior_returns(cov: DataFrame, market: DataFrame, views: DataFrame, aversion: float = 2.5) -> DataFrame:
    """code, equilibrium, posterior: returns that the market's weights(code, weight) imply by cov(a, b, cov; each pair once), blended with
    views(code, view, confidence from 0 to 1) where there are some."""
    pairs = cov.unionAll(cov.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    implied = pairs.join(market.select(F.col("code").alias("b"), "weight"), "b").groupBy(F.col("a").alias("code")).agg((F.sum(F.col("cov") * F.col("weight")) * aversion).alias("equilibrium"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return implied.join(views, "code", "left").select("code", "equilibrium", (F.col("equilibrium") * (1 - sure) + F.coalesce("view", F.lit(0.0)) * sure).alias("posterior"))


def blended(parts: dict[str, DataFrame], shares: dict[str, float]) -> DataFrame:
    """code, weight: the parts' weights(code, weight) by their shares, summing to 1; a code that a part lacks has weight 0 there."""
    rows = None
    for name, part in parts.items():
        own = part.select("code", (F.coalesce("weight", F.lit(0.0)) * shares[name]).alias("w"))
        rows = own if rows is None else rows.unionAll(own)
    by = rows.groupBy("code").agg(F.sum("w").alias("w"))
    return by.select("code", F.coalesce(sdiv("w", F.sum("w").over(Window.partitionBy())), F.col("w")).alias("weight"))  # a row a code


def scan(spot: DataFrame, n: int = 20, cap: tuple[float, float] = (0.0, float("inf")), most_pe: float = 60.0) -> DataFrame:
    """The n first by score of rows whose market cap and earnings multiple pass; an unknown figure passes."""
    ok = (F.col("market_cap").isNull() | F.col("market_cap").between(*cap)) & (F.col("pe").isNull() | ((F.col("pe") > 0) & (F.col("pe") <= most_pe)))
    return spot.where(ok).orderBy(F.desc("score"), "code").limit(n)  # the report's length


def opportunity_score() -> Column:
    """Points for momentum, liquidity and value, up to 100."""
    return (
        F.when(F.col("change") > 0.05, 40).when(F.col("change") > 0, 25).otherwise(0) + F.when(F.col("volume_ratio") > 1.5, 30).when(F.col("volume_ratio") > 1, 15).otherwise(0)
        + F.when(F.col("pe").between(0, 20), 30).when(F.col("pe").between(0, 40), 15).otherwise(0)
    )


def signal_score(momentum: str = "momentum", volume_ratio: str = "volume_ratio", flow: str = "fund_flow") -> Column:
    """30 points for rising prices, 30 for volume above one and a half times the usual, 40 for money coming in."""
    points = ((F.col(momentum) > 0, 30), (F.col(volume_ratio) > 1.5, 30), (F.col(flow) > 0, 40))
    return sum((F.when(hit, n).otherwise(0) for hit, n in points), F.lit(0))


def shortlist(spot: DataFrame, least: int = 70, score: Column | None = None) -> DataFrame:
    """code and score of the rows that reach `least` points."""
    return spot.withColumn("score", score if score is not None else signal_score()).where(F.col("score") >= least)


def grade(score: str | Column) -> Column:
    return F.when(col(score) >= 80, "A").when(col(score) >= 60, "B").when(col(score) >= 40, "C").otherwise("D")


def book_pressure(bids: str | Column, asks: str | Column) -> Column:
    """(bids - asks) / (bids + asks) of the volumes of a book's levels (arrays); 0 for an empty book."""

    def total(x: str | Column) -> Column:
        return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))

    return F.coalesce(sdiv(total(bids) - total(asks), total(bids) + total(asks)), F.lit(0.0))


def flow(trades: DataFrame, key: str, large: float | None = None) -> DataFrame:
    """key, bought, sold, net_ratio: amounts by side, of trades above `large` only by choice."""
    amount = F.col("price") * F.col("quantity")
    rows = trades.where(amount > large) if large is not None else trades
    by = rows.groupBy(key).agg(F.sum(F.when(F.col("side") == "buy", amount).otherwise(0.0)).alias("bought"), F.sum(F.when(F.col("side") == "sell", amount).otherwise(0.0)).alias("sold"))
    return by.withColumn("net_ratio", F.coalesce(sdiv(F.col("bought") - F.col("sold"), F.col("bought") + F.col("sold")), F.lit(0.0)))


def votes(df: DataFrame, item: str, vote: str, weight: str) -> DataFrame:
    """item, votes, winner, share: the vote of the greatest weight (ties: the first by name) and its share."""
    by = df.groupBy(item, vote).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
    return by.groupBy(item).agg(F.sum("n").alias("votes"), F.min_by(vote, F.struct(-F.col("w"), F.col(vote))).alias("winner"), sdiv(F.max("w"), F.sum("w")).alias("share"))


def review(trades: DataFrame, gain: str = "gain") -> DataFrame:
    """One row: trades, win rate, mean gain, mean win and loss."""
    g = col(gain)
    return trades.agg(F.count(g).alias("n"), sdiv(F.count_if(g > 0), F.count(g)).alias("win_rate"), F.avg(g).alias("mean"), F.avg(F.when(g > 0, g)).alias("mean_win"), F.avg(F.when(g < 0, g)).alias("mean_loss"))


def date_share(x: str) -> Column:
    return sdiv(x, F.sum(col(x)).over(by_date()))
