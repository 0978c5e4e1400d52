"""Technical and fundamental factors as columns: any number of them share one exchange by code."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import col, log_positive, mean_present, sdiv
from ..functions.windows import by_code, lag, lead, rank_pct, roll_max, roll_mean, roll_std, running


def momentum(n: int) -> Column:
    return sdiv("close", lag("close", n)) - 1


def reversal(n: int) -> Column:
    return -momentum(n)


def with_day_return(panel: DataFrame) -> DataFrame:
    """Adds `ret`, the one-row return that volatility and volume trends are made of."""
    return panel.withColumn("ret", sdiv("close", lag("close")) - 1)


def volatility(n: int, annual: bool = False) -> Column:
    """Of the column ret."""
    v = roll_std("ret", n)
    return v * F.sqrt(F.lit(252.0)) if annual else v


def with_true_range(panel: DataFrame) -> DataFrame:
    prev = lag("close")
    return panel.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def average_true_range(n: int) -> Column:
    """Of the column tr."""
    return roll_mean("tr", n)


def mean_deviation(n: int) -> Column:
    return sdiv("close", roll_mean("close", n)) - 1


def ratio_to_mean(x: str, n: int) -> Column:
    """A row's volume, amount or the like over its mean of n rows."""
    return sdiv(x, roll_mean(x, n))


def breakout(n: int) -> Column:
    return sdiv("close", roll_max("high", n)) - 1


def drawdown(n: int) -> Column:
    return sdiv("close", roll_max("close", n)) - 1


def high_low_range() -> Column:
    return sdiv(col("high") - col("low"), "close")


def close_location() -> Column:
    return sdiv(col("close") - col("low"), col("high") - col("low"))


def with_volume_trend(panel: DataFrame) -> DataFrame:
    """Adds `pvt`, the running sum of volume times return; needs ret."""
    return panel.withColumn("pvt", running(F.coalesce(F.col("volume") * F.col("ret"), F.lit(0.0))))


def volume_trend(n: int) -> Column:
    return F.col("pvt") - lag("pvt", n)


def smoothed(panel: DataFrame, alpha: float, **columns: str) -> DataFrame:
    """panel with new columns, each the exponential smoothing of another by date: y = (1 - alpha) * y before + alpha * x, from the first x on; nulls change nothing.

    Each row is the map y -> a * y + b, and maps of rows in a row compose to one of the same form. In blocks of rows they compose by running sums of b scaled by powers
    of a; each row then takes the end of the block before. Blocks are as long as the powers fit a double, so that what comes from further back is below its
    smallest step. Windows by code, one exchange.
    """
    a = 1 - alpha
    size = max(1, int(-550 / math.log(a))) if 0 < a < 1 else 1
    upto = by_code().rowsBetween(Window.unboundedPreceding, 0)
    for name, x in columns.items():
        panel = panel.withColumn("__n", F.count(x).over(upto) - 1).withColumns({"__block": F.floor(F.col("__n") / size), "__k": F.col("__n") % size})
        # the first value stands for all before it
        step = F.col(x) * F.when(F.col("__n") == 0, 1.0).otherwise(alpha)
        inside = Window.partitionBy("code", "__block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        panel = panel.withColumn("__own", F.sum(F.when(F.col(x).isNotNull(), step * F.pow(F.lit(a), -F.col("__k")))).over(inside) * F.pow(F.lit(a), F.col("__k")))
        ended = F.when((F.col("__k") == size - 1) & F.col(x).isNotNull(), F.col("__own"))
        before = F.last(ended, ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, -1))
        panel = panel.withColumn("__before", before)
        # rows after a block's end without a value of their own belong to it still
        carried = F.when(F.col("__block") > 0, F.col("__before") * F.pow(F.lit(a), F.col("__k") + 1))
        panel = panel.withColumn(name, F.when(F.col("__n") >= 0, F.col("__own") + F.coalesce(carried, F.lit(0.0)))).drop("__n", "__block", "__k", "__own", "__before")
    return panel


def with_rsi(panel: DataFrame, n: int = 14, name: str = "rsi") -> DataFrame:
    """panel with Wilder's relative strength: gains and losses smoothed by 1 / n, null for the first n rows and for rows without a close."""
    step = F.col("close") - lag("close")
    made = smoothed(panel.withColumn("__step", step).withColumns({"__gain": F.greatest("__step", F.lit(0.0) * F.col("__step")), "__loss": F.greatest(-F.col("__step"), F.lit(0.0) * F.col("__step"))}), 1 / n, __up="__gain", __down="__loss")
    made = made.withColumn("__seen", F.count("__step").over(by_code().rowsBetween(Window.unboundedPreceding, 0)))
    up, down = F.col("__up"), F.col("__down")
    value = F.when((down == 0) & (up > 0), 100.0).when(down == 0, 50.0).otherwise(100 - 100 / (1 + sdiv(up, down)))
    return made.withColumn(name, F.when((F.col("__seen") >= n) & F.col("close").isNotNull(), value)).drop("__step", "__gain", "__loss", "__up", "__down", "__seen")


def rsi(panel: DataFrame, n: int = 14) -> DataFrame:
    """code, date and rsi of `with_rsi`."""
    return with_rsi(panel.select("code", "date", "close"), n).select("code", "date", "rsi")


def technical(panel: DataFrame, *, spans: dict[str, int] | None = None) -> DataFrame:
    """panel with the default set of technical factors."""
    s = {"momentum": 20, "reversal": 5, "volatility": 20, "atr": 14, "ma": 20, "volume": 20, "breakout": 20, "drawdown": 20, "pvt": 20} | (spans or {})
    base = with_volume_trend(with_true_range(with_day_return(panel)))
    return base.withColumns({
        "momentum": momentum(s["momentum"]), "reversal": reversal(s["reversal"]), "volatility": volatility(s["volatility"]), "atr": average_true_range(s["atr"]),
        "ma_deviation": mean_deviation(s["ma"]), "volume_ratio": ratio_to_mean("volume", s["volume"]), "amount_ratio": ratio_to_mean("amount", s["volume"]),
        "breakout": breakout(s["breakout"]), "drawdown": drawdown(s["drawdown"]), "high_low_range": high_low_range(), "close_location": close_location(), "pvt_change": volume_trend(s["pvt"]),
    }).drop("ret", "tr", "pvt")


#: The default set: factor and its spans.
DEFAULT_SPANS = {
    "momentum": (5, 20, 60, 120), "reversal": (5, 20), "volatility": (20, 60), "atr": (14,), "rsi": (14,), "ma_deviation": (5, 20, 60), "volume_ratio": (5, 20), "amount_ratio": (5, 20),
    "turnover_mean": (20,), "breakout": (20, 60), "drawdown": (20, 60), "high_low_range": (None,), "close_location": (None,), "pvt_change": (20,),
}


def default_set(panel: DataFrame, spans: dict[str, tuple] | None = None) -> DataFrame:
    """code, date and the default technical factors, <factor>_<span>: all windows, those of the rsi's recurrence as well, share one exchange by code.

    turnover is the panel's column of that name.
    """
    made = {
        "momentum": momentum, "reversal": reversal, "volatility": lambda n: volatility(n, True), "atr": average_true_range, "ma_deviation": mean_deviation,
        "volume_ratio": lambda n: ratio_to_mean("volume", n), "amount_ratio": lambda n: ratio_to_mean("amount", n), "turnover_mean": lambda n: roll_mean("turnover", n),
        "breakout": breakout, "drawdown": drawdown, "high_low_range": lambda _: high_low_range(), "close_location": lambda _: close_location(), "pvt_change": volume_trend,
    }
    spans = DEFAULT_SPANS if spans is None else spans
    base = with_volume_trend(with_true_range(with_day_return(panel)))
    columns = {f"{k}_{n}" if n else k: made[k](n) for k, ns in spans.items() if k != "rsi" for n in ns}
    kept = [f"rsi_{n}" for n in spans.get("rsi", ())]
    for n in spans.get("rsi", ()):
        base = with_rsi(base, n, f"rsi_{n}")
    return base.select("code", "date", *[c.alias(k) for k, c in columns.items()], *kept)


def features(panel: DataFrame) -> DataFrame:
    """code, date, return_1, ma5, ma20, volume_change, momentum, target (the next close is higher); rows with all of them known."""
    out = panel.select(
        "code", "date", (sdiv("close", lag("close")) - 1).alias("return_1"), roll_mean("close", 5).alias("ma5"), roll_mean("close", 20).alias("ma20"),
        ratio_to_mean("volume", 20).alias("volume_change"), momentum(20).alias("momentum"), (lead("close") > F.col("close")).cast("int").alias("target"),
    )
    return out.na.drop()


def run(panel: DataFrame, factors: dict[str, Column], stages=None) -> tuple[DataFrame, DataFrame]:
    """(values, diagnostics) of factors by name: each made, then put through stages (a function of frame and column name), failures apart.

    values: code, date and the factors that could be made. diagnostics: factor, status, n, coverage, mean, std, smallest, largest, days; a
    factor that can't be made (a missing column, a wrong type) has status `failed`, n and days 0 and the rest null.
    """
    out, good = panel, []
    for name, column in factors.items():
        try:
            trial = out.withColumn(name, column)
            trial = stages(trial, name) if stages else trial
            assert trial.schema[name].dataType.simpleString() in ("double", "float", "int", "bigint"), "not a number"
        except (AnalysisException, AssertionError):
            continue
        out, good = trial, [*good, name]
    values = out.select("code", "date", *good)
    long = values.unpivot(["code", "date"], good, "factor", "v") if good else values.select("code", "date", F.lit(None).cast("string").alias("factor"), F.lit(None).cast("double").alias("v")).where("false")
    v = F.col("v").cast("double")
    by = long.groupBy("factor").agg(
        F.count(v).alias("n"), sdiv(F.count(v), F.count(F.lit(1))).alias("coverage"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("smallest"),
        F.max(v).alias("largest"), F.count_distinct(F.when(v.isNotNull(), F.col("date"))).alias("days"),
    )
    names = panel.sparkSession.createDataFrame([(k, "ok" if k in good else "failed") for k in factors], "factor string, status string")
    return values, names.join(F.broadcast(by), "factor", "left").na.fill(0, ["n", "days"])


def fundamental() -> dict[str, Column]:
    """The default fundamental factors; with the composites below, sixteen."""
    return {
        "earnings_yield": sdiv(F.lit(1.0), "pe"), "book_to_market": sdiv(F.lit(1.0), "pb"), "sales_yield": sdiv(F.lit(1.0), "ps"), "roe": col("roe"), "roic": col("roic"),
        "profit_margin": sdiv("net_profit", "revenue"), "asset_turnover": sdiv("revenue", "total_assets"), "leverage": sdiv("total_assets", "equity"),
        "revenue_growth": col("revenue_growth"), "profit_growth": col("profit_growth"), "roe_growth": col("roe_growth"), "market_cap": col("market_cap"), "log_market_cap": log_positive("market_cap"),
    }


#: Composites: the factors whose ranks of the date are averaged, and those of them that count the other way.
COMPOSITES = {
    "value": (("earnings_yield", "book_to_market", "sales_yield"), ()),
    "quality": (("roe", "roic", "profit_margin", "leverage"), ("leverage",)),
    "growth": (("revenue_growth", "profit_growth"), ()),
}


def composite(panel: DataFrame, name: str) -> DataFrame:
    """panel with <name>_composite from factor columns it has."""
    parts, inverse = COMPOSITES[name]
    ranked = panel.withColumns({f"__{p}": rank_pct(-col(p) if p in inverse else p) for p in parts})
    return ranked.withColumn(f"{name}_composite", mean_present(*[f"__{p}" for p in parts])).drop(*[f"__{p}" for p in parts])


def custom(panel: DataFrame, name: str, fn) -> DataFrame:
    """panel with a factor of the user's: fn takes a code's rows (pandas, by date) and returns a series of its values."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema if f.name != name)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        return group.assign(**{name: pd.Series(fn(group), index=group.index, dtype="float64")})

    keep = [c for c in panel.columns if c != name]
    return panel.select(*keep).groupBy("code").applyInPandas(run, f"{kinds}, `{name}` double")


def positive_yield(x: str) -> Column:
    """1 / x of multiples above 0; null for losses and nonsense."""
    return sdiv(F.lit(1.0), F.when(col(x) > 0, col(x)))


def plain_mean(*xs: str | Column) -> Column:
    """Mean of those that are not null, 0 if none is: composites as older callers want them."""
    return F.coalesce(mean_present(*xs), F.lit(0.0))
