"""Windows of a panel (date, code): by code over time, and by date across codes.

All windows by code share one exchange, all by date another. Ties across codes go by code.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .num import col, sdiv


def by_code():
    return Window.partitionBy("code").orderBy("date")


def by_date():
    return Window.partitionBy("date")


def rolling(n: int):
    return by_code().rowsBetween(-(n - 1), 0)


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(by_code())


def lead(x: str | Column, k: int = 1) -> Column:
    return F.lead(col(x), k).over(by_code())


def full(n: int, x: str | Column, value: Column, least: int | None = None) -> Column:
    """value where the last n rows hold `least` (else n) values of x that are not null."""
    return F.when(F.count(col(x)).over(rolling(n)) >= (least or n), value)


def roll_mean(x: str | Column, n: int, least: int | None = None) -> Column:
    return full(n, x, F.avg(col(x)).over(rolling(n)), least)


def roll_std(x: str | Column, n: int, least: int | None = None) -> Column:
    return full(n, x, F.stddev_samp(col(x)).over(rolling(n)), least)


def roll_max(x: str | Column, n: int, least: int | None = None) -> Column:
    return full(n, x, F.max(col(x)).over(rolling(n)), least)


def roll_min(x: str | Column, n: int, least: int | None = None) -> Column:
    return full(n, x, F.min(col(x)).over(rolling(n)), least)


def running(x: str | Column) -> Column:
    return F.sum(col(x)).over(by_code().rowsBetween(Window.unboundedPreceding, 0))


def present(x: str | Column):
    """Rows of a date whose x is (or all whose x is not) null, apart, so that nulls take no rank."""
    return Window.partitionBy("date", col(x).isNull())


def rank_pct(x: str | Column) -> Column:
    """Average rank of ties, by the number of values of the date."""
    x = col(x)
    w = present(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy("date", x.isNull(), x))
    return F.when(x.isNotNull(), (F.rank().over(w.orderBy(x)) + (ties - 1) / F.lit(2.0)) / F.count(F.lit(1)).over(w))


def average_rank(x: str | Column, *group: str) -> Column:
    """Average rank of ties within groups, nulls apart."""
    x = col(x)
    w = Window.partitionBy(*group, x.isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, x.isNull(), x))
    return F.when(x.isNotNull(), F.rank().over(w.orderBy(x)) + (ties - 1) / F.lit(2.0))


def position(x: str | Column) -> Column:
    """Row number by x, then code, among the date's values."""
    return F.row_number().over(present(x).orderBy(col(x), "code"))


def quantile_by_rank(x: str | Column, q: int) -> Column:
    """1 to q: the rank's share of the date's values, rounded up; 1 if all values are one."""
    x = col(x)
    n = F.count(x).over(by_date())
    flat = F.min(x).over(by_date()) == F.max(x).over(by_date())
    return F.when(x.isNotNull(), F.when(flat, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(q), F.ceil(position(x) / n * q)))).cast("int"))


def quantile_by_cut(x: str | Column, q: int) -> Column:
    """1 to q: cuts of the ranks at even quantiles between the first and the last."""
    x = col(x)
    n = F.count(x).over(by_date())
    return F.when(x.isNotNull() & (n > 1), F.greatest(F.lit(1), F.ceil((position(x) - 1) * q / (n - 1))).cast("int"))


def quantile_by_value(x: str | Column, q: int) -> Column:
    """1 to q or fewer: cuts at the values' even percentiles, equal cuts counted once; null if all values are one."""
    x = col(x)
    cuts = F.array_distinct(F.percentile(x, [i / q for i in range(q + 1)]).over(by_date()))
    inner = F.slice(cuts, F.lit(2), F.greatest(F.size(cuts) - 2, F.lit(0)))
    return F.when(x.isNotNull() & (F.size(cuts) > 1), F.size(F.filter(inner, lambda c: c < x)) + 1)


def scorr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate over pairs that are both known; null if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))


def demeaned(x: str | Column, *group: str) -> Column:
    return col(x) - F.avg(col(x)).over(Window.partitionBy(*group))


def share(x: str | Column, *group: str) -> Column:
    return sdiv(x, F.sum(col(x)).over(Window.partitionBy(*group)))
