"""Panel operators: selection, returns, forward windows, calendars and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.num import finite, half_up, sdiv
from ..functions.windows import by_code, by_date, lag, lead


def between(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a span of dates; the condition reaches the scan."""
    return panel.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def cross_section(panel: DataFrame, date: str, tradeable: bool = False) -> DataFrame:
    out = panel.where(F.col("date") == F.lit(date).cast("date"))
    return out.where("is_tradeable") if tradeable else out


def limit_rate(code: str = "code", st: str | None = None) -> Column:
    """A board's daily limit: 30 percent for codes of 4 and 8, 20 for 300 and 688, else 10, or 5 under special treatment (the flag `st`)."""
    c = F.col(code)
    return F.when(c.rlike("^[48]"), 0.30).when(c.rlike("^(300|688)"), 0.20).when(F.coalesce(st, F.lit(False)) if st else F.lit(False), 0.05).otherwise(0.10)


def limit_flags(panel: DataFrame, slack: float = 0.011, rate: Column | None = None) -> DataFrame:
    """prev_close, limit_up and limit_down: the close within `slack` of the limit price, which is rounded half up."""
    prev, r = F.col("prev_close"), rate if rate is not None else limit_rate()
    out = panel.withColumn("prev_close", lag("close"))
    return out.withColumns({
        "limit_up": F.coalesce(F.col("close") >= half_up(prev * (1 + r)) - slack, F.lit(False)),
        "limit_down": F.coalesce(F.col("close") <= half_up(prev * (1 - r)) + slack, F.lit(False)),
    })


def returns(panel: DataFrame, *periods: int) -> DataFrame:
    """return_k: close over the close k rows before, missing closes filled forward."""
    filled = panel.withColumn("__c", F.last("close", ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumns({f"return_{k}": sdiv("__c", lag("__c", k)) - 1 for k in periods}).drop("__c")


def forward_return(h: int) -> Column:
    return sdiv(lead("close", h), "close") - 1


def next_open_return() -> Column:
    return sdiv(lead("close"), lead("open")) - 1


def open_to_close(h: int) -> Column:
    """Enter at the next open, leave at the close h rows on."""
    return sdiv(lead("close", h), lead("open")) - 1


def open_to_open(h: int = 1) -> Column:
    return sdiv(lead("open", h + 1), lead("open")) - 1


def forward_returns(panel: DataFrame, horizon: int = 1, entry: str = "open", exit: str = "close", same_day: bool = False, positive: bool = True) -> DataFrame:
    """panel with entry_date, exit_date, entry_price, exit_price, forward_return and forward_return_valid.

    Enter at the next row's `entry` (the row's own with same_day), leave at the `exit` of the row `horizon` on. Valid if both prices are known and, by choice, above
    0; the return is null where a price is unknown or the entry is 0. Rows of a code go by date, one exchange.
    """
    at = 0 if same_day else 1
    take = lambda x, k: F.lead(x, k).over(by_code())
    out = panel.withColumns({"entry_date": take("date", at), "exit_date": take("date", horizon), "entry_price": finite(take(entry, at)), "exit_price": finite(take(exit, horizon))})
    valid = F.col("entry_price").isNotNull() & F.col("exit_price").isNotNull()
    if positive:
        valid = valid & (F.col("entry_price") > 0) & (F.col("exit_price") > 0)
    return out.withColumns({"forward_return": sdiv("exit_price", "entry_price") - 1, "forward_return_valid": F.coalesce(valid, F.lit(False))})


def forward_return_stats(df: DataFrame) -> DataFrame:
    """One row of `forward_returns`: n_rows, n_valid, n_missing, and mean, median, std (0 of a single one), smallest and largest return known."""
    r, n = F.col("forward_return"), F.count(F.lit(1))
    good = F.count_if("forward_return_valid")
    std = F.when(F.count(r) == 1, 0.0).otherwise(F.stddev_samp(r))
    return df.agg(n.alias("n_rows"), good.alias("n_valid"), (n - good).alias("n_missing"), F.avg(r).alias("mean"), F.percentile(r, 0.5).alias("median"), std.alias("std"), F.min(r).alias("smallest"), F.max(r).alias("largest"))


def forward_max(h: int) -> Column:
    """Highest high of the next h rows over the close; null if one of them is unknown or there is none."""
    w = by_code().rowsBetween(1, h)
    known = (F.count(F.lit(1)).over(w) > 0) & (F.count("high").over(w) == F.count(F.lit(1)).over(w))
    return F.when(known, sdiv(F.max("high").over(w), "close") - 1)


def forward_drawdown(h: int) -> Column:
    """Lowest low of the next h rows over the close."""
    return sdiv(F.min("low").over(by_code().rowsBetween(1, h)), "close") - 1


def excess(x: str = "fwd") -> Column:
    return F.col(x) - F.avg(x).over(by_date())


def calendar(panel: DataFrame) -> DataFrame:
    """Trading days and their ordinals from 0: as many rows as days, so one partition holds them."""
    days = panel.select("date").where("date IS NOT NULL").distinct()
    return days.withColumn("ordinal", F.row_number().over(Window.orderBy("date")) - 1)


def shift_days(dates: DataFrame, days: DataFrame, k: int) -> DataFrame:
    """dates(date) with `shifted`, the trading day k on (or back); null beyond the calendar or on days without trade."""
    here, there = days.select("date", "ordinal"), days.select(F.col("date").alias("shifted"), (F.col("ordinal") - k).alias("ordinal"))
    return dates.join(here, "date", "left").join(there, "ordinal", "left").drop("ordinal")


def previous_day(dates: DataFrame, days: DataFrame) -> DataFrame:
    """dates(date) with `previous`: the last trading day up to the date itself."""
    both = dates.select("date", F.lit(None).cast("date").alias("day")).unionAll(days.select("date", F.col("date").alias("day")))
    w = Window.orderBy("date", F.col("day").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return both.withColumn("previous", F.last("day", ignorenulls=True).over(w)).where("day IS NULL").select("date", "previous")


def quality(panel: DataFrame) -> DataFrame:
    """One row: rows, codes, dates, repeated keys, missing closes and zero volumes, in one pass after counting by key."""
    keys = panel.groupBy("date", "code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("close").isNull()).alias("m"), F.count_if(F.coalesce(F.col("volume"), F.lit(0)) <= 0).alias("z"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_distinct("code").alias("n_codes"), F.count_distinct("date").alias("n_dates"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_no_close"), F.coalesce(F.sum("z"), F.lit(0)).alias("n_no_volume"),
    )


def in_universe() -> Column:
    """Rows that may be traded: tradeable, not suspended, not under special treatment; unknown flags count as their defaults."""
    return F.coalesce("is_tradeable", F.lit(True)) & ~F.coalesce("suspended", F.lit(False)) & ~F.coalesce("is_st", F.lit(False))


def can_trade(side: str) -> Column:
    """If a row can be bought (not at its upper limit) or sold (not at its lower one)."""
    limit = {"buy": "limit_up", "sell": "limit_down"}[side]
    return F.coalesce("is_tradeable", F.lit(True)) & ~F.coalesce(limit, F.lit(False))


def stock_pool(spot: DataFrame, least_amount: float = 50_000_000.0) -> DataFrame:
    """spot(name, price, amount, ...) without names of special treatment, suspended ones (no price) and illiquid ones."""
    return spot.where(~F.coalesce(F.col("name").contains("ST"), F.lit(False)) & (F.col("price") > 0) & (F.col("amount") >= least_amount))


def crash(panel: DataFrame, drop: float = -0.2, by: str = "code") -> DataFrame:
    """panel with `stressed`: the close, from the middle of each code's rows on times 1 + drop."""
    nth, n = F.row_number().over(Window.partitionBy(by).orderBy("date")), F.count(F.lit(1)).over(Window.partitionBy(by))
    return panel.withColumn("stressed", F.when(nth > F.floor(n / 2), F.col("close") * (1 + drop)).otherwise(F.col("close")))


def shaken(panel: DataFrame, volatility: float = 0.05, seed: int = 42, by: str = "code") -> DataFrame:
    """panel with `stressed`: the close times the running product of 1 + normal shocks, which hang on seed, code and date alone."""
    # two uniform numbers of a row make a normal one
    one, two = ((F.pmod(F.xxhash64(F.lit(seed + k), by, "date"), F.lit(1 << 53)) + 1) / float((1 << 53) + 1) for k in (0, 1))
    shocked = panel.withColumn("__shock", F.log(1 + volatility * F.sqrt(-2 * F.log(one)) * F.cos(2 * F.pi() * two)))
    return shocked.withColumn("stressed", F.col("close") * F.exp(F.sum("__shock").over(Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))).drop("__shock")


def book_levels(payload: str | Column, first: int, step: int = 2, levels: int = 5) -> Column:
    """The volumes of a book's levels in a payload split by commas: fields first, first + step, ...; fields that are no number are null."""
    parts = F.split(F.col(payload) if isinstance(payload, str) else payload, ",")
    return F.array(*[F.get(parts, F.lit(first + k * step)).try_cast("double") for k in range(levels)])


def weekday_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Mondays to Fridays from start to end and their ordinals from 0, for want of an exchange's calendar; none if start is after end."""
    span = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    days = spark.range(1).select(F.explode(F.when(F.lit(start).cast("date") <= F.lit(end).cast("date"), span)).alias("date")).where(F.weekday("date") < 5)
    return days.withColumn("ordinal", F.row_number().over(Window.orderBy("date")) - 1)  # a row a day


def days_between(days: DataFrame, start: str, end: str, with_start: bool = True, with_end: bool = True) -> DataFrame:
    """Trading days from start to end, each end counted by choice."""
    d, a, b = F.col("date"), F.lit(start).cast("date"), F.lit(end).cast("date")
    return days.where((d >= a if with_start else d > a) & (d <= b if with_end else d < b))


def nearest_day(dates: DataFrame, days: DataFrame, forward: bool = False) -> DataFrame:
    """dates(date) with `nearest` and its `ordinal`: the date itself if it is a trading day, else the last one before or, forward, the first one after; null beyond."""
    both = dates.select("date", F.lit(None).cast("date").alias("day"), F.lit(None).cast("int").alias("ordinal")).unionByName(days.select("date", F.col("date").alias("day"), "ordinal"))
    frame = (0, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, 0)
    # a trading day comes last of its date's rows, forward first
    w = Window.orderBy("date", F.col("day").isNotNull() if forward else F.col("day").isNull()).rowsBetween(*frame)  # a row a date
    pick = F.first if forward else F.last
    return both.withColumns({"nearest": pick("day", ignorenulls=True).over(w), "ordinal_": pick("ordinal", ignorenulls=True).over(w)}).where("day IS NULL").select("date", "nearest", F.col("ordinal_").alias("ordinal"))


def shift_from(dates: DataFrame, days: DataFrame, k: int) -> DataFrame:
    """dates(date) with `shifted`, k trading days on: from a day without trade counted from the next trading day, for negative k from the last one."""
    there = days.select(F.col("date").alias("shifted"), (F.col("ordinal") - k).alias("ordinal"))
    return nearest_day(dates, days, k >= 0).join(there, "ordinal", "left").select("date", "shifted")
