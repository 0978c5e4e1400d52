"""A factor's run from checked input to diagnostics, in one plan.

Checks are part of the plan: a row that breaks one raises as it is read, with its key in the message, so no job runs ahead of the real one and nothing is written
from bad input. Checks that need several rows (repeated keys, a factor without values) are windows or aggregates of the same plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import finite, sdiv
from .pit import availability


def demand(df: DataFrame, holds: Column, message: str, *names: str) -> DataFrame:
    """df whose rows must hold a condition: one that doesn't (or is null) raises with the message and the values of the named columns, as soon as it is read."""
    told = [F.concat(F.lit(f"{n}="), F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("null"))) for n in names]
    fail = F.raise_error(F.concat_ws(" ", F.lit(f"{message}:"), *told))
    # on a column that every later step needs, so that no step can leave the check out
    key = names[0]
    return df.withColumn(key, F.when(F.coalesce(holds, F.lit(False)), F.col(f"`{key}`")).otherwise(fail.cast(df.schema[key].dataType)))


def checked_input(panel: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """panel(code, date, ...) with keys that are known and unique; a column that it lacks raises at once."""
    if missing := [c for c in ("code", "date", *columns) if c not in panel.columns]:
        raise ValueError(f"the panel lacks {', '.join(missing)}")
    keyed = demand(panel, F.col("code").isNotNull() & F.col("date").isNotNull(), "a row without a key", "code", "date")
    return demand(keyed.withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy("code", "date"))), F.col("__same") == 1, "a repeated key", "code", "date").drop("__same")


def known_in_time(facts: DataFrame, as_of: str | None = None) -> DataFrame:
    """facts that were all known by as_of (or by their own date): the explicit date counts, else the announcement's; a fact without either, or a later one, raises.

    A period's end is no proof that a fact was known.
    """
    kinds = availability(facts)
    limit = F.lit(as_of).cast("date") if as_of else F.col("date")
    timely = F.col("availability_type").isin("explicit", "announcement") & (F.col("known_date") <= limit)
    return demand(kinds, timely, f"a fact not known by {as_of or 'its date'}", "code", "date", "known_date").select(*facts.columns)


def run(
    facts: DataFrame,
    factors: Mapping[str, Column],
    as_of: str | None = None,
    universe: DataFrame | None = None,
    stages: Callable[[DataFrame, str], DataFrame] | None = None,
    least_coverage: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """(values, diagnostics) of factors by name, over facts(code, date, ...).

    In this order: keys are known and unique; every fact was known in time; codes outside universe(code) go; factors are made; stages (a function of frame and
    column name) normalize them; values must be finite or null, and a factor known on a smaller share of rows than least_coverage raises. values: code, date and
    the factors. diagnostics: factor, n, coverage, mean, std, smallest, largest.
    """
    panel = known_in_time(checked_input(facts), as_of)
    if universe is not None:
        panel = panel.join(universe.select("code").distinct(), "code", "left_semi")
    out = panel.withColumns(dict(factors))
    for name in factors:
        out = demand(out, F.col(name).isNull() | finite(name).isNotNull(), f"{name} is not finite", "code", "date", name)
        out = stages(out, name) if stages else out
    values = out.select("code", "date", *factors)
    long = values.unpivot(["code", "date"], list(factors), "factor", "v")
    v = F.col("v").cast("double")
    by = long.groupBy("factor").agg(F.count(v).alias("n"), sdiv(F.count(v), F.count(F.lit(1))).alias("coverage"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("smallest"), F.max(v).alias("largest"))
    return values, demand(by, F.col("coverage") >= least_coverage, f"a factor is known on less than {least_coverage} of the rows", "factor", "coverage")
