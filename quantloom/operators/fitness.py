"""Fitness of signals from a table of their measures: weighted bounded scores less penalties, and gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the parts, scales of the bounded ones, and rates of the penalties (fixed values).
WEIGHTS = {"ic": 0.30, "icir": 0.20, "quantile_spread": 0.20, "long_short_spread": 0.10, "hit_rate": 0.10, "oos": 0.10}
SCALES = {"ic": 0.03, "icir": 1.00, "quantile_spread": 0.03, "long_short_spread": 0.03, "oos_ic": 0.03, "oos_icir": 1.00, "oos_quantile_spread": 0.03}
PENALTIES = {"turnover": 0.10, "complexity": 0.01, "max_correlation": 0.10, "max_drawdown": 0.10, "volatility": 0.0}


def squash(x: str, scale: float) -> Column:
    return F.tanh(F.col(x) / scale)


def hit_score(x: str) -> Column:
    """A hit rate between -1 and 1, 0 at one half; null outside 0 to 1."""
    return F.when(F.col(x).between(0, 1), 2 * F.col(x) - 1)


def weighted_mean(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """The mean of what is known; null if nothing is."""
    top = sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    below = sum((F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    return F.try_divide(top, F.nullif(below, F.lit(0.0)))


def fitness(measures: DataFrame, weights: Mapping[str, float] = WEIGHTS, scales: Mapping[str, float] = SCALES, penalties: Mapping[str, float] = PENALTIES) -> DataFrame:
    """measures with score, penalty, fitness (score less penalty). A measure that the table lacks or a row doesn't know is left out."""
    have = set(measures.columns)
    none = F.lit(None).cast("double")
    bounded = {k: squash(k, scales[k]) if k in have else none for k in scales}
    after = [bounded[k] for k in ("oos_ic", "oos_icir", "oos_quantile_spread")]
    known = sum((c.isNotNull().cast("int") for c in after), F.lit(0))
    parts = {k: bounded[k] for k in ("ic", "icir", "quantile_spread", "long_short_spread")}
    parts["hit_rate"] = hit_score("hit_rate") if "hit_rate" in have else none
    parts["oos"] = F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in after), F.lit(0.0)), F.nullif(known, F.lit(0)))
    size = {"max_drawdown": lambda c: F.abs(c), "max_correlation": lambda c: F.greatest(c, F.lit(0.0))}
    cost = sum((F.coalesce(size.get(k, lambda c: c)(F.col(k)) * rate, F.lit(0.0)) for k, rate in penalties.items() if k in have), F.lit(0.0))
    out = measures.withColumns({"score": weighted_mean(parts, weights), "penalty": cost})
    return out.withColumn("fitness", F.col("score") - F.col("penalty"))


def gates(measures: DataFrame, least: Mapping[str, float] | None = None, most: Mapping[str, float] | None = None, positive_oos: bool = True) -> DataFrame:
    """measures with failures (an array of names) and accepted: measures below `least`, above `most` in size, or unknown fail."""
    failed = []
    for limits, bad in ((least or {}, lambda c, v: c < v), (most or {}, lambda c, v: F.abs(c) > v)):
        for k, v in limits.items():
            c = F.col(k) if k in measures.columns else F.lit(None).cast("double")
            failed.append(F.when(c.isNull(), f"missing_{k}").when(bad(c, v), f"{k}_failed_threshold"))
    if positive_oos:
        c = F.col("oos_ic") if "oos_ic" in measures.columns else F.lit(None).cast("double")
        failed.append(F.when(c.isNull(), "missing_oos_ic").when(c <= 0, "oos_ic_not_positive"))
    names = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return measures.withColumn("failures", names).withColumn("accepted", F.size("failures") == 0)


def _prime(n: int) -> int:
    """The least prime from n on."""
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def tournament(measures: DataFrame, rounds: int, size: int, seed: int = 0, key: str = "alpha", by: str = "fitness") -> DataFrame:
    """round, key, by: the fittest of `size` drawn in each round, without putting back (ties by the greater key); unknown fitness takes no part.

    Rows are numbered once, in an order that hangs on the seed. A round draws places in steps of its own modulo a prime, so no place comes twice, and looks up only
    these: work goes as the rows and as rounds times size.
    """
    rows = measures.where(F.col(by).isNotNull()).select(key, by)
    n = rows.count()
    if not n:
        return rows.select(F.lit(0).alias("round"), key, by).where("false")
    p, size = _prime(n), min(size, n)
    numbered = rows.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), key), key)) - 1)  # a row a candidate
    luck = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "round")
    # p - n places have no row, so that many more are drawn
    draws = measures.sparkSession.range(rounds).select(F.col("id").cast("int").alias("round"))
    draws = draws.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size + p - n - 1)))).withColumn("place", F.pmod(F.pmod(luck("from"), F.lit(p)) + F.col("j") * (F.pmod(luck("step"), F.lit(p - 1)) + 1), F.lit(p)).cast("int"))
    nth = F.row_number().over(Window.partitionBy("round").orderBy("j"))
    drawn = draws.where(F.col("place") < n).withColumn("nth", nth).where(F.col("nth") <= size).join(numbered, "place")
    best = F.max(F.struct(F.col(by).alias("v"), F.col(key).alias("k")))
    return drawn.groupBy("round").agg(best.alias("x")).select("round", F.col("x.k").alias(key), F.col("x.v").alias(by))
