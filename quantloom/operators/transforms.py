"""Cross-sectional transforms by date and neutralization."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import clip, col, finite, log_positive, sdiv
from ..functions.windows import by_date, demeaned, rank_pct, scorr


def _names(x: str, out: str | None) -> tuple[str, str]:
    return out or x, f"__{x}"


def rank(x: str | Column, centered: bool = False) -> Column:
    return rank_pct(x) - (0.5 if centered else 0.0)


def rank_normalize(x: str | Column) -> Column:
    return (rank_pct(x) - 0.5) * 2


def zscore(x: str | Column, flat: float | None = 0.0, eps: float = 1e-12) -> Column:
    """Population z-score of the date; `flat` (0 or null) where the deviation is no larger than eps (0: where all values are one)."""
    x = col(x)
    sd = F.stddev_pop(x).over(by_date())
    return F.when(x.isNotNull(), F.when(sd > eps, F.try_divide(x - F.avg(x).over(by_date()), F.nullif(sd, F.lit(0.0)))).otherwise(F.lit(flat)))


def minmax(x: str | Column) -> Column:
    x = col(x)
    lo, hi = F.min(x).over(by_date()), F.max(x).over(by_date())
    return F.when(x.isNotNull(), F.coalesce(sdiv(x - lo, hi - lo), F.lit(0.5)))


def median(x: str | Column) -> Column:
    return F.percentile(col(x), 0.5).over(by_date())


def with_robust_zscore(df: DataFrame, x: str, out: str | None = None) -> DataFrame:
    """By the median and 1.4826 times the median absolute deviation of the date; 0 where that is 0."""
    name, tmp = _names(x, out)
    dev = df.withColumn(tmp, col(x) - median(x))
    mad = F.percentile(F.abs(col(tmp)), 0.5).over(by_date()) * 1.4826
    return dev.withColumn(name, F.when(col(tmp).isNotNull(), F.coalesce(sdiv(tmp, mad), F.lit(0.0)))).drop(tmp)


def winsorize_quantile(x: str | Column, q: float = 0.01) -> Column:
    x = col(x)
    return clip(x, F.percentile(x, q).over(by_date()), F.percentile(x, 1 - q).over(by_date()))


def with_winsorized_mad(df: DataFrame, x: str, limit: float = 3.0, out: str | None = None) -> DataFrame:
    """Within `limit` scaled median absolute deviations of the date's median."""
    name, tmp = _names(x, out)
    dev = df.withColumn(tmp, col(x) - median(x))
    reach = F.percentile(F.abs(col(tmp)), 0.5).over(by_date()) * (1.4826 * limit)
    mid = col(x) - col(tmp)
    return dev.withColumn(name, clip(x, mid - reach, mid + reach)).drop(tmp)


def fill(x: str | Column, how: str = "median") -> Column:
    """Nulls as the date's median or mean, or 0."""
    value = {"median": lambda: median(x), "mean": lambda: F.avg(col(x)).over(by_date()), "zero": lambda: F.lit(0.0)}[how]()
    return F.coalesce(col(x), value)


def pipeline(df: DataFrame, x: str, out: str, missing: str = "median", limit: float = 3.0, standard: str = "zscore") -> DataFrame:
    """Fill, winsorize by MAD, standardize: windows by date alone, so one exchange."""
    done = with_winsorized_mad(df.withColumn(out, fill(x, missing)), out, limit)
    if standard == "robust":
        return with_robust_zscore(done, out)
    return done.withColumn(out, {"zscore": zscore, "minmax": minmax, "rank": rank, "rank_normalize": rank_normalize}[standard](out))


def summary(df: DataFrame, x: str) -> DataFrame:
    c = col(x)
    return df.groupBy("date").agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("lowest"), F.max(c).alias("highest"), F.count_if(c.isNull()).alias("missing"))


def neutralize_group(x: str, *group: str) -> Column:
    return demeaned(x, "date", *(group or ("industry",)))


def neutralize_size(df: DataFrame, x: str, size: str = "market_cap", out: str = "residual", industry: str | None = "industry", least: int = 3) -> DataFrame:
    """Residual of x on the log of size (and industries) by date: both are demeaned by industry, then one slope a date takes size out."""
    group = ["date", industry] if industry else ["date"]
    known = F.col("__s").isNotNull() & col(x).isNotNull()
    base = df.withColumn("__s", log_positive(size))
    base = base.withColumns({"__y": F.when(known, col(x)), "__s": F.when(known, F.col("__s"))})
    base = base.withColumns({"__y": demeaned("__y", *group), "__s": demeaned("__s", *group)})
    slope = F.coalesce(sdiv(F.sum(F.col("__y") * F.col("__s")).over(by_date()), F.sum(F.col("__s") * F.col("__s")).over(by_date()), eps=1e-12), F.lit(0.0))
    value = F.when(F.count("__y").over(by_date()) >= least, F.col("__y") - slope * F.col("__s"))
    return base.withColumn(out, value).drop("__y", "__s")


def orthogonalize(df: DataFrame, x: str, controls: Sequence[str], out: str = "residual", diagnostics: bool = False) -> DataFrame:
    """Residual of x on any number of controls and a constant, by date; null on dates with no more known rows than coefficients.

    Sums over a date's rows, as windows of one exchange: controls are centred, then each in turn is taken out of the later ones and of x. A control that the ones before
    it explain (to a part in 10^12 of its squares) takes nothing out. With diagnostics also <out>_r2, the share of a date's squares that the controls explain.
    """
    known = F.lit(True)
    for c in (x, *controls):
        known = known & finite(c).isNotNull()
    parts = ["__y", *[f"__c{i}" for i in range(len(controls))]]
    base = df.withColumns({p: F.when(known, col(c).cast("double")) for p, c in zip(parts, (x, *controls), strict=True)})
    base = base.withColumns({p: demeaned(p, "date") for p in parts})
    base = base.withColumns({f"{p}_all": F.sum(F.col(p) * F.col(p)).over(by_date()) for p in parts})
    for i, p in enumerate(parts[1:], 1):
        own = F.sum(F.col(p) * F.col(p)).over(by_date())
        later = ["__y", *parts[i + 1 :]]
        slope = {q: F.when(own > F.col(f"{p}_all") * 1e-12, sdiv(F.sum(F.col(p) * F.col(q)).over(by_date()), own)) for q in later}
        base = base.withColumns({q: F.col(q) - F.coalesce(s, F.lit(0.0)) * F.col(p) for q, s in slope.items()})
    enough = F.count("__y").over(by_date()) > len(controls) + 1
    made = {out: F.when(enough, F.col("__y"))}
    if diagnostics:
        made[f"{out}_r2"] = F.when(enough, 1 - sdiv(F.sum(F.col("__y") * F.col("__y")).over(by_date()), "__y_all"))
    return base.withColumns(made).drop(*parts, *[f"{p}_all" for p in parts])


def exposure(df: DataFrame, x: str, *to: str) -> DataFrame:
    """One row: correlations of x with each exposure."""
    return df.agg(*[scorr(col(x), col(t)).alias(f"corr_{t}") for t in to])


