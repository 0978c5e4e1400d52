"""Null-safe arithmetic. NaN and infinities become null as soon as they could arise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sdiv(a: str | Column, b: str | Column, eps: float | None = None) -> Column:
    """a / b; null where b is zero (or no larger than eps)."""
    a, b = col(a).cast("double"), col(b).cast("double")
    small = F.abs(b) <= eps if eps is not None else b == 0
    return F.try_divide(a, F.when(~small, b))


def finite(x: str | Column) -> Column:
    """x as a double, null if it is NaN or infinite."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x: str | Column, lo, hi) -> Column:
    """x between bounds; null stays null (least and greatest alone would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo) if not isinstance(lo, Column) else lo, F.least(F.lit(hi) if not isinstance(hi, Column) else hi, x)))


def safe_log(x: str | Column, eps: float = 1e-12) -> Column:
    """ln(|x| + eps); eps 0 gives null at 0."""
    v = F.abs(col(x).cast("double"))
    return F.log(v + F.lit(eps)) if eps else F.when(v > 0, F.log(v))


def log_positive(x: str | Column) -> Column:
    return F.when(col(x) > 0, F.log(col(x).cast("double")))


def half_up(x: str | Column, digits: int = 2) -> Column:
    """Rounds halves towards positive infinity, on the double itself."""
    m = float(10**digits)
    return F.floor(col(x) * m + F.lit(0.5)) / F.lit(m)


def half_even(x: str | Column, digits: int = 2) -> Column:
    """Rounds halves to the even neighbour."""
    return F.bround(col(x), digits)


def lots(value: str | Column, price: str | Column, lot: int = 100) -> Column:
    """Shares in whole lots that a value buys; null without a price."""
    return (F.floor(sdiv(value, price) / F.lit(float(lot))) * lot).cast("long")


def percent(x: str | Column) -> Column:
    """Numbers from text: "12.3%" is 0.123; blanks, dashes, None and nan are null."""
    t = F.trim(col(x).cast("string"))
    gone = t.isin("", "-", "--", "None", "none", "nan", "NaN", "null")
    n = F.regexp_replace(t, "[%,]", "").try_cast("double")
    return F.when(~gone, F.when(t.endswith("%"), n / F.lit(100.0)).otherwise(n))


def security_code(x: str | Column, width: int = 6) -> Column:
    """Codes padded with zeros to a width; longer ones stay as they are."""
    t = F.regexp_replace(F.trim(col(x).cast("string")), r"\.0$", "")
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def exchange_code(x: str | Column) -> Column:
    """Six digits with the exchange that their first digits tell: 6, 9 SH; 4, 8 BJ; else SZ."""
    d = security_code(F.regexp_replace(F.upper(col(x).cast("string")), "[^0-9]", ""))
    return F.concat(d, F.when(d.rlike("^[69]"), ".SH").when(d.rlike("^[48]"), ".BJ").otherwise(".SZ"))


def truthy(x: str | Column) -> Column:
    """Booleans from text; null is false."""
    return F.coalesce(F.lower(F.trim(col(x).cast("string"))).isin("true", "1", "1.0", "yes", "y", "t", "是"), F.lit(False))


def mean_present(*xs: str | Column) -> Column:
    """Mean of those that are not null; null if none is."""
    cols = [col(x).cast("double") for x in xs]
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return sdiv(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)), n)


def steps(x: str | Column, *rungs: tuple[float, float], otherwise: float = 0.0) -> Column:
    """The points of the first rung (least value, points) that x reaches."""
    out = None
    for least, points in rungs:
        hit = col(x) >= least
        out = F.when(hit, F.lit(points)) if out is None else out.when(hit, F.lit(points))
    return out.otherwise(F.lit(otherwise))
