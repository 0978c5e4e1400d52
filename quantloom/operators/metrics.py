"""Measures of signals and of return series."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import col, finite, sdiv
from ..functions.windows import by_code, by_date, average_rank, lag, lead, quantile_by_cut, quantile_by_rank, quantile_by_value, scorr


def ic(df: DataFrame, x: str = "signal", y: str = "fwd", least: int = 5, ranks: bool = False) -> DataFrame:
    """date, n, ic: correlation (of average ranks) of a signal with what follows it, over the date's known pairs; null below `least`; to 12 places, so that none is zero but for its error."""
    both = df.where(col(x).isNotNull() & col(y).isNotNull())
    if ranks:
        both = both.select("date", average_rank(x, "date").alias(x), average_rank(y, "date").alias(y))
    return both.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.round(scorr(col(x), col(y)), 12)).alias("ic"))


def ic_summary(series: DataFrame) -> DataFrame:
    c = F.col("ic")
    n = F.count(c)
    return series.agg(
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), sdiv(F.avg(c), F.stddev_samp(c)).alias("ir"), sdiv(F.count_if(c > 0), n).alias("positive"),
        sdiv(F.count_if(c < 0), n).alias("negative"), F.avg(F.abs(c)).alias("absolute"), n.alias("n_days"),
    )


def quantile_returns(df: DataFrame, q: int = 5, by_cut: bool = False, x: str = "signal", y: str = "fwd") -> DataFrame:
    """date, q1 .. qn, high_low: mean returns of the signal's quantiles."""
    both = df.where(col(x).isNotNull() & col(y).isNotNull()).withColumn("__q", (quantile_by_cut if by_cut else quantile_by_rank)(x, q))
    out = both.groupBy("date").agg(*[F.avg(F.when(F.col("__q") == k, col(y))).alias(f"q{k}") for k in range(1, q + 1)])
    return out.withColumn("high_low", F.col(f"q{q}") - F.col("q1"))


def tail_spread(df: DataFrame, low: float = 0.2, high: float = 0.8, least: int = 5, x: str = "signal", y: str = "fwd") -> DataFrame:
    """date, spread: mean return at or above the high percentile of the signal less that at or below the low one."""
    both = df.where(col(x).isNotNull() & col(y).isNotNull())
    marked = both.select("date", x, y, F.percentile(col(x), low).over(by_date()).alias("lo"), F.percentile(col(x), high).over(by_date()).alias("hi"))
    spread = F.avg(F.when(col(x) >= F.col("hi"), col(y))) - F.avg(F.when(col(x) <= F.col("lo"), col(y)))
    return marked.groupBy("date").agg(F.when(F.count(F.lit(1)) >= least, spread).alias("spread"))


def top_holdings(df: DataFrame, n: int, x: str = "signal") -> DataFrame:
    """date, held: the codes of the n greatest signals of a date, ties by code; n is the strategy's size."""
    w = Window.partitionBy("date").orderBy(F.desc(x), "code")
    return df.where(col(x).isNotNull()).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).groupBy("date").agg(F.sort_array(F.collect_list("code")).alias("held"))


def _days():
    return Window.orderBy("date")  # over a row a date


def turnover_overlap(held: DataFrame) -> DataFrame:
    """date, turnover: share of the holdings that the last date did not have; 1 at first."""
    before = F.lag("held").over(_days())
    return held.select("date", (1 - F.size(F.array_intersect("held", F.coalesce(before, F.array().cast("array<string>")))) / F.size("held")).alias("turnover"))


def turnover_union(held: DataFrame) -> DataFrame:
    """date, turnover: holdings of one date alone by those of both; null at first."""
    before = F.lag("held").over(_days())
    change = F.size(F.array_except("held", before)) + F.size(F.array_except(before, "held"))
    return held.select("date", F.when(before.isNotNull(), change / F.size(F.array_union("held", before))).alias("turnover"))


def turnover_weights(weights: DataFrame, half: bool = True) -> DataFrame:
    """date, turnover: absolute changes of weights(date, code, weight) since the date before (all dates of the table), halved.

    A code that leaves counts on the date after its last: it is carried there with weight 0.
    """
    days = weights.select("date").distinct().withColumn("nth", F.row_number().over(_days()))
    w = weights.join(days, "date").select("nth", "code", "weight")
    changes = w.unionAll(w.select(F.col("nth") + 1, "code", -F.col("weight")))
    moved = changes.groupBy("nth", "code").agg(F.abs(F.sum("weight")).alias("d"))
    total = moved.groupBy("nth").agg((F.sum("d") * (0.5 if half else 1.0)).alias("turnover"))
    return days.where("nth > 1").join(total, "nth").select("date", "turnover")


def equal_weights(df: DataFrame, q: int = 5, long_short: bool = False, x: str = "signal") -> DataFrame:
    """date, code, weight: 1 / n of the top quantile, or half of that long and half short in the bottom one."""
    marked = df.withColumn("__q", quantile_by_rank(x, q)).where(F.col("__q").isin(1, q) if long_short else F.col("__q") == q)
    n = F.count(F.lit(1)).over(Window.partitionBy("date", "__q"))
    side = F.when(F.col("__q") == q, 1.0).otherwise(-1.0) * (0.5 if long_short else 1.0)
    return marked.select("date", "code", (side / n).alias("weight"))


def autocorrelation(df: DataFrame, x: str = "signal", k: int = 1) -> DataFrame:
    return df.select(col(x).alias("a"), lag(x, k).alias("b")).agg(scorr(F.col("a"), F.col("b")).alias("autocorr"))


def decay(panel: DataFrame, x: str, horizons: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """One row: pooled correlation of a signal with the returns of several horizons, from one pass of leads."""
    with_leads = panel.select(x, *[(sdiv(lead("close", h), "close") - 1).alias(f"f{h}") for h in horizons])
    return with_leads.agg(*[scorr(col(x), F.col(f"f{h}")).alias(f"corr_{h}") for h in horizons])


def equity(series: DataFrame, ret: str = "ret") -> DataFrame:
    """series(date, ret) with equity (running product) and drawdown from its peak (at least 1)."""
    upto = _days().rowsBetween(Window.unboundedPreceding, 0)
    curve = series.withColumn("equity", F.product(1 + F.coalesce(col(ret), F.lit(0.0))).over(upto))
    return curve.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(upto)) - 1)


def performance(series: DataFrame, ret: str = "ret", year: float = 252.0, ddof: int = 1) -> DataFrame:
    """One row of a return series' measures."""
    c = col(ret)
    sd = F.stddev_samp(c) if ddof else F.stddev_pop(c)
    down = F.sqrt(F.avg(F.pow(F.least(c, F.lit(0.0)), 2)))
    curve = equity(series, ret)
    n = F.count(c)
    total = F.max_by("equity", "date") - 1
    return curve.agg(
        n.alias("n"), F.avg(c).alias("mean"), (sd * F.sqrt(F.lit(year))).alias("volatility"), total.alias("total_return"), (F.pow(1 + total, F.lit(year) / n) - 1).alias("annual_return"),
        (sdiv(F.avg(c), sd) * F.sqrt(F.lit(year))).alias("sharpe"), (sdiv(F.avg(c), down) * F.sqrt(F.lit(year))).alias("sortino"), F.min("drawdown").alias("max_drawdown"),
        sdiv(F.avg(c) * year, -F.min("drawdown")).alias("calmar"), sdiv(F.count_if(c > 0), n).alias("win_rate"),
        sdiv(F.sum(F.when(c > 0, c)), -F.sum(F.when(c < 0, c))).alias("profit_factor"),
    )


def risk_ratios(series: DataFrame, ret: str = "ret", year: float = 252.0) -> DataFrame:
    """One row by the other definition: sortino and calmar of the yearly growth, by the deviation of the losses alone and the deepest drawdown;
    0 without losses, a drawdown or a loss to divide by."""
    c, n = col(ret), F.count(col(ret))
    lost = F.when(c < 0, c)
    out = equity(series, ret).agg(n.alias("n"), F.max_by("equity", "date").alias("__e"), F.stddev_samp(lost).alias("__d"), F.count(lost).alias("__k"), F.min("drawdown").alias("__m"), F.sum(F.when(c > 0, c)).alias("__w"), F.sum(lost).alias("__l"))
    growth = F.pow(F.col("__e"), F.lit(year) / F.col("n")) - 1
    return out.select(
        "n", growth.alias("growth"), F.when(F.col("__k") > 1, growth / F.greatest(F.col("__d") * F.sqrt(F.lit(year)), F.lit(1e-8))).otherwise(0.0).alias("sortino"),
        F.when(F.col("__m") < 0, growth / F.abs("__m")).otherwise(0.0).alias("calmar"), F.when(F.col("__l") < 0, F.coalesce("__w", F.lit(0.0)) / F.abs("__l")).otherwise(0.0).alias("profit_factor"),
    )


#: Parts of an equity curve's score (fixed values).
CURVE_SCORE = {"cagr": 0.30, "sharpe": 0.25, "sortino": 0.15, "calmar": 0.15, "total_return": 0.15}


def curve_performance(curve: DataFrame, value: str = "equity", ddof: int = 1, calendar: bool = True, none: float | None = None, floor: float = 0.0, year: float = 252.0, stop: float = -0.15) -> DataFrame:
    """One row of an equity curve(date, value): n, total_return, cagr, volatility, sharpe, sortino, max_drawdown, calmar, score, stopped.

    Variants of one measure are options. ddof: of all deviations. calendar: years are days by 365.25, else rows by `year`. none: what sharpe, sortino and calmar are
    where there is no deviation, loss or drawdown (null or 0). floor: the least deviation of losses that is divided by. sortino goes by the deviation of the losses
    alone. score: weighted sum of the parts; stopped: the deepest drawdown is below `stop`. Null and non-finite values are left out; null measures with fewer than two.
    """
    rows = curve.select("date", finite(value).alias("v")).where("v IS NOT NULL")
    days = _days()
    rows = rows.withColumns({"r": sdiv("v", F.lag("v").over(days)) - 1, "dd": sdiv("v", F.max("v").over(days.rowsBetween(Window.unboundedPreceding, 0))) - 1})  # a row a day
    spread = F.stddev_samp if ddof else F.stddev_pop
    first, last = F.min_by("v", "date"), F.max_by("v", "date")
    one = rows.agg(
        F.count("v").alias("n"), (sdiv(last, first) - 1).alias("total_return"), F.datediff(F.max("date"), F.min("date")).alias("__days"), F.avg("r").alias("__mean"), spread("r").alias("__sd"),
        spread(F.when(F.col("r") < 0, F.col("r"))).alias("__down"), F.count_if(F.col("r") < 0).alias("__lost"), F.min("dd").alias("max_drawdown"),
    )
    years = F.greatest(F.col("__days") / 365.25, F.lit(1 / 365.25)) if calendar else F.greatest(F.col("n") / year, F.lit(1 / year))
    whole, root, missing = F.col("total_return"), F.sqrt(F.lit(year)), F.lit(none).cast("double")
    down = F.greatest("__down", F.lit(floor)) if floor else F.col("__down")
    had_losses = F.col("__lost") > 0 if floor else F.col("__down") > 0
    one = one.withColumns({"cagr": F.when(whole > -1, F.pow(1 + whole, 1 / years) - 1).otherwise(-1.0), "volatility": F.col("__sd") * root})
    one = one.withColumns({
        "sharpe": F.when(F.col("__sd") > 0, sdiv("__mean", "__sd") * root).otherwise(missing), "sortino": F.when(had_losses, sdiv("__mean", down) * root).otherwise(missing),
        "calmar": F.when(F.col("max_drawdown") < 0, sdiv("cagr", F.abs("max_drawdown"))).otherwise(missing), "stopped": F.col("max_drawdown") < stop,
    })
    one = one.withColumn("score", sum((F.col(k) * w for k, w in CURVE_SCORE.items()), F.lit(0.0)))
    measures = ["total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "score", "stopped"]
    return one.select("n", *[F.when(F.col("n") > 1, F.col(m)).alias(m) for m in measures])


def long_picks(df: DataFrame, x: str = "signal", share: float = 0.8) -> DataFrame:
    """date, code, x, cut: the rows of each date at or above the date's percentile `share` of x (between ranks in proportion)."""
    cut = F.percentile(x, share).over(by_date())
    return df.select("date", "code", x).withColumn("cut", cut).where(F.col(x) >= F.col("cut"))


def order_statistic(df: DataFrame, x: str, k: int, probes: int = 32, most: int = 10_000) -> float | None:
    """The value at place k (from 0) of x in rising order, exact; nulls take no part, null beyond the last.

    Rounds count the rows below probes, which a sketch of the rows left sets, and keep the interval between two probes that holds the place, until it has at most
    `most` rows: those are read. No sort of all rows, nothing of them in one task.
    """
    v = col(x)
    left, below = df.where(v.isNotNull()), 0
    while True:
        r = left.agg(F.count(v).alias("n"), F.percentile_approx(v, [i / (probes - 1) for i in range(probes)], 1000).alias("c")).first()
        if k < below or k - below >= r.n:
            return None
        if r.n <= most:
            return sorted(x[0] for x in left.select(v).collect())[k - below]
        cuts = sorted(set(r.c))
        row = left.agg(*[F.count_if(v < c).alias(f"a{i}") for i, c in enumerate(cuts)], *[F.count_if(v <= c).alias(f"b{i}") for i, c in enumerate(cuts)]).first()
        under, upto = [below + row[f"a{i}"] for i in range(len(cuts))], [below + row[f"b{i}"] for i in range(len(cuts))]
        for i, c in enumerate(cuts):
            if under[i] <= k < upto[i]:
                return c
        at = max((i for i in range(len(cuts)) if upto[i] <= k), default=None)
        keep = F.lit(True) if at is None else v > cuts[at]
        if at is None or at + 1 < len(cuts):
            keep = keep & (v < cuts[0 if at is None else at + 1])
        left, below = left.where(keep), below if at is None else upto[at]


def value_at_risk(series: DataFrame, ret: str = "ret", confidence: float = 0.95) -> DataFrame:
    """One row: the return at the place n * (1 - confidence) from the lowest; none without returns."""
    n = series.agg(F.count(col(ret)).alias("n")).first().n
    value = order_statistic(series, ret, math.floor(round(n * (1 - confidence), 9))) if n else None
    return series.sparkSession.createDataFrame([(value,)] if n else [], "value_at_risk double")


def correlations(wide: DataFrame, names: list[str]) -> DataFrame:
    """a, b, corr of every two of the named columns: one aggregation, then a row each."""
    pairs = list(combinations(names, 2))
    row = wide.agg(*[scorr(col(a), col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def gram_correlations(wide: DataFrame, names: list[str], least: int = 30, block: int = 64) -> DataFrame:
    """a, b, n, corr of every two of the named columns over the rows where both are known; null below `least` rows or if one is constant there.

    Each task multiplies its rows once for all pairs and hands on counts and sums in blocks of block x block pairs; blocks are summed in two steps by a shuffle, so the
    plan has the same size for two columns and for hundreds. Columns are shifted by their means first, so that sums of squares don't cancel.
    """
    spark, s = wide.sparkSession, len(names)
    plain = wide.select(*[finite(c).alias(f"c{i}") for i, c in enumerate(names)])
    means = plain.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in plain.columns]).first()
    sent = spark.sparkContext.broadcast(np.array(means, np.float64))  # a number a column
    cuts = [(at, min(at + block, s)) for at in range(0, s, block)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, s, s))
        for b in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in b.columns]) - sent.value
            m = (~np.isnan(x)).astype(np.float64)
            x = np.where(m > 0, x, 0.0)
            sums += (m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x)
        rows = [(i, j, sums[:, a:b, c:d].ravel()) for i, (a, b) in enumerate(cuts) for j, (c, d) in enumerate(cuts) if j >= i]
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["i", "j", "part", "sums"])

    def total(rows: pa.Table) -> np.ndarray:
        return np.stack(rows.column("sums").to_numpy()).sum(axis=0)

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"i": rows.column("i")[:1], "j": rows.column("j")[:1], "sums": pa.array([total(rows)], pa.list_(pa.float64()))})

    def told(key: tuple, rows: pa.Table) -> pa.Table:
        (a, b), (c, d) = cuts[key[0].as_py()], cuts[key[1].as_py()]
        n, x, y, xx, yy, xy = total(rows).reshape(6, b - a, d - c)
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy, cov = xx - x * x / n, yy - y * y / n, xy - x * y / n
            ok = (n >= least) & (vx > 1e-12 * xx) & (vy > 1e-12 * yy)
            corr = np.where(ok, np.clip(cov / np.sqrt(vx * vy), -1, 1), 0)
        p, q = np.nonzero(np.arange(a, b)[:, None] < np.arange(c, d))
        names_of = lambda at, k: pa.array([names[at + i] for i in k], pa.string())
        return pa.table({"a": names_of(a, p), "b": names_of(c, q), "n": pa.array(n[p, q].astype(np.int64)), "corr": pa.array(corr[p, q], mask=~ok[p, q])})

    parts = plain.mapInArrow(partial, "i int, j int, part int, sums array<double>")
    return parts.groupBy("i", "j", "part").applyInArrow(merged, "i int, j int, sums array<double>").groupBy("i", "j").applyInArrow(told, "a string, b string, n long, corr double")


def code_return(panel: DataFrame) -> DataFrame:
    return panel.select("date", "code", (sdiv("close", F.lag("close").over(by_code())) - 1).alias("ret"))


def covariance(rets: DataFrame, scale: float = 252.0) -> DataFrame:
    """a, b, cov of every two codes' returns(date, code, ret) on their common dates: a join by date, so as wide as a date's codes."""
    a, b = rets.select("date", F.col("code").alias("a"), F.col("ret").alias("x")), rets.select("date", F.col("code").alias("b"), F.col("ret").alias("y"))
    return a.join(b, "date").where("a <= b AND x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b").agg((F.covar_samp("x", "y") * scale).alias("cov"))


def portfolio_volatility(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: the square root of the weights' quadratic form; pairs off the diagonal count twice."""
    wa, wb = weights.select(F.col("code").alias("a"), F.col("weight").alias("wa")), weights.select(F.col("code").alias("b"), F.col("weight").alias("wb"))
    term = F.col("wa") * F.col("wb") * F.col("cov") * F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    return cov.join(wa, "a").join(wb, "b").agg(F.sqrt(F.sum(term)).alias("volatility"))


def scaled_rank(x: str) -> Column:
    return sdiv(average_rank(x, "date"), F.count(col(x)).over(by_date()))


def value_quantile_spread(df: DataFrame, q: int = 5, x: str = "signal", y: str = "fwd") -> DataFrame:
    """date, buckets, spread: mean return of the highest bucket by value less that of the lowest; null with one bucket."""
    both = df.where(col(x).isNotNull() & col(y).isNotNull()).withColumn("__q", quantile_by_value(x, q)).where("__q IS NOT NULL")
    means = both.groupBy("date", "__q").agg(F.avg(y).alias("m"))
    ends = means.groupBy("date").agg(F.count(F.lit(1)).alias("buckets"), F.max_by("m", "__q").alias("high"), F.min_by("m", "__q").alias("low"))
    return ends.select("date", "buckets", F.when(F.col("buckets") > 1, F.col("high") - F.col("low")).alias("spread"))


def quantile_summary(quantiles: DataFrame, q: int = 5) -> DataFrame:
    """One row of quantile_returns: q1_mean .. qn_mean, high_low_mean, _std, _ir, _positive."""
    h = F.col("high_low")
    return quantiles.agg(*[F.avg(f"q{k}").alias(f"q{k}_mean") for k in range(1, q + 1)], F.avg(h).alias("high_low_mean"), F.stddev_samp(h).alias("high_low_std"), sdiv(F.avg(h), F.nullif(F.stddev_samp(h), F.lit(0.0))).alias("high_low_ir"), sdiv(F.count_if(h > 0), F.count(h)).alias("high_low_positive"))


def diversity(df: DataFrame, key: str) -> DataFrame:
    """One row: n, distinct, diversity (their ratio)."""
    return df.agg(F.count(key).alias("n"), F.count_distinct(key).alias("distinct"), sdiv(F.count_distinct(key), F.count(key)).alias("diversity"))
