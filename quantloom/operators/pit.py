"""Point-in-time facts: availability, as-of joins, universes by interval, corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import sdiv


def availability(df: DataFrame) -> DataFrame:
    """known_date, its kind and confidence: the explicit date, else the announcement's, else the period's end (uncertain)."""
    order = [("available_date", "explicit", "high"), ("announcement_date", "announcement", "medium"), ("report_period", "report_period", "low")]
    has = [(F.col(c), k, s) for c, k, s in order if c in df.columns]

    def first(pick) -> Column:
        out = F.when(has[0][0].isNotNull(), pick(has[0]))
        for h in has[1:]:
            out = out.when(h[0].isNotNull(), pick(h))
        return out

    return df.withColumns({"known_date": F.coalesce(*[c for c, _, _ in has]), "availability_type": F.coalesce(first(lambda h: F.lit(h[1])), F.lit("unknown")), "confidence": F.coalesce(first(lambda h: F.lit(h[2])), F.lit("none"))})


def known_as_of(df: DataFrame, as_of: str | None = None, keep_unknown: bool = False, known: str = "available_date") -> DataFrame:
    """Rows known by as_of (or by their own date)."""
    on = F.col(known) <= (F.lit(as_of).cast("date") if as_of else F.col("date"))
    return df.where(on | F.col(known).isNull()) if keep_unknown else df.where(on)


def look_ahead(df: DataFrame, known: str = "available_date") -> DataFrame:
    return df.where(F.col(known) > F.col("date"))


def latest(df: DataFrame, as_of: str, key: str = "code", known: str = "available_date", tie: str = "fact_id") -> DataFrame:
    """Each key's last row known by as_of; of equal dates that of the greater `tie`. Keeps a row a key in each task before the shuffle."""
    rows = known_as_of(df, as_of, known=known)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(known, tie)).alias("r"))
    return best.select(key, "r.*")


def date_edges(dates: DataFrame, on: str, ranges: int) -> list:
    """At most ranges - 1 dates that cut dates(on) into ranges of about as many rows, by a sketch of quantiles."""
    if ranges < 2:
        return []
    places = [i / ranges for i in range(1, ranges)]
    cuts = dates.select(F.percentile_approx(F.unix_date(F.col(on).cast("date")), places, 1000).alias("c")).first().c
    return sorted(set(cuts or []))


def range_of(on: str, edges: list) -> Column:
    """The number of a date's range: of the edges, how many are not after it."""
    day = F.unix_date(F.col(on).cast("date"))
    return sum(((day >= e).cast("int") for e in edges), F.lit(0))


def as_of_join(left: DataFrame, facts: DataFrame, columns: list[str], key: str = "code", on: str = "date", known: str = "available_date", tie: str = "fact_id", ranges: int = 16) -> DataFrame:
    """left with the facts' columns as last known on each row's date, that day's included; null before the first.

    Two levels: dates are cut into ranges (by quantiles of the facts' dates, which are the smaller side), and facts and rows of a key and a range meet in one sort, facts before rows of the same date, the last one carried on. A
    range's last fact goes to the ranges after it by a table of a row a key and range, joined on the partitioning that is there already. So a key with very many
    rows is sorted by several tasks.
    """
    f = facts.where(F.col(known).isNotNull()).select(key, F.col(known).alias(on), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.struct(*columns).alias("__fact"))
    edges = date_edges(f, on, ranges)
    f = f.withColumn("__range", range_of(on, edges))
    rest = [c for c in left.columns if c not in (key, on)]
    both = left.select(key, on, F.lit(1).alias("__side"), F.struct(*rest).alias("__row"), range_of(on, edges).alias("__range")).unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(key, "__range").orderBy(on, "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("__fact", F.last("__fact", ignorenulls=True).over(w)).where("__side = 1")
    if edges:
        # each task keeps a row a key and range; then a key has at most as many rows as there are ranges
        ends = f.groupBy(key, "__range").agg(F.max_by("__fact", F.struct(on, "__tie")).alias("__end"))
        until = F.lead("__range", 1, len(edges) + 1).over(Window.partitionBy(key).orderBy("__range"))
        to = F.least(F.col("__until"), F.lit(len(edges)))
        carry = ends.withColumn("__until", until).select(key, "__end", F.explode(F.when(F.col("__range") < to, F.sequence(F.col("__range") + 1, to))).alias("__range"))
        own = own.join(carry, [key, "__range"], "left").withColumn("__fact", F.coalesce("__fact", "__end"))
    return own.select(key, on, *[F.col("__row")[c].alias(c) for c in rest], *[F.col("__fact")[c].alias(c) for c in columns])


def snapshots(dates: DataFrame, facts: DataFrame, columns: list[str], key: str = "code", known: str = "available_date", tie: str = "fact_id") -> DataFrame:
    """For each of dates(date) and each key, the last fact known then.

    Dates are numbered; a merge of both kinds of dates (a row a date) tells each known date the first number from it on. A fact holds from there to
    the next fact of its key, so its rows are a run of numbers: no grid and no join of ranges.
    """
    days = dates.select("date").distinct().withColumn("n", F.row_number().over(Window.orderBy("date")))  # a row a date
    asked = facts.where(F.col(known).isNotNull()).select(F.col(known).alias("date")).distinct()
    after = Window.orderBy("date", F.col("n").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    start = asked.withColumn("n", F.lit(None).cast("int")).unionByName(days).withColumn("from", F.first("n", ignorenulls=True).over(after)).where("n IS NULL AND from IS NOT NULL").select(F.col("date").alias(known), "from")
    # of the facts that start on one date the last; each task keeps one a key and date
    held = facts.join(start, known).groupBy(key, "from").agg(F.max_by(F.struct(*columns), F.struct(known, tie)).alias("__fact"))
    until = F.lead("from").over(Window.partitionBy(key).orderBy("from"))
    last = days.agg(F.max("n").alias("__last"))  # one row
    runs = held.withColumn("__until", until).crossJoin(F.broadcast(last)).select(key, "__fact", F.explode(F.sequence("from", F.coalesce(F.col("__until") - 1, F.col("__last")))).alias("n"))
    return runs.join(days, "n").select(key, "date", *[F.col("__fact")[c].alias(c) for c in columns])


def audit(df: DataFrame) -> DataFrame:
    """One row: shares of rows with an explicit, announced, only a period's or no date."""
    kinds = availability(df)
    n = F.count(F.lit(1))
    return kinds.agg(n.alias("n_rows"), *[sdiv(F.count_if(F.col("availability_type") == k), n).alias(f"{k}_share") for k in ("explicit", "announcement", "report_period", "unknown")])


def active(date: Column | str, inclusive_delist: bool = False) -> Column:
    """If a security with list_date and delist_date is alive on a date; the day of delisting counts by choice."""
    d = F.col(date) if isinstance(date, str) else date
    end = (d <= F.col("delist_date")) if inclusive_delist else (d < F.col("delist_date"))
    return F.coalesce((d >= F.col("list_date")) & (F.col("delist_date").isNull() | end), F.lit(False))


def universe(lives: DataFrame, date: str, inclusive_delist: bool = False, allow_st: bool = True) -> DataFrame:
    out = lives.where(active(F.lit(date).cast("date"), inclusive_delist))
    return out if allow_st else out.where("NOT is_st")


def universe_sizes(lives: DataFrame, dates: DataFrame) -> DataFrame:
    """Members on each of dates(date), by a running sum of listings less delistings: no join of ranges."""
    turns = lives.where("list_date IS NOT NULL").select(F.col("list_date").alias("date"), F.lit(1).alias("n")).unionAll(lives.where("delist_date IS NOT NULL AND list_date IS NOT NULL").select("delist_date", F.lit(-1)))
    by_day = turns.groupBy("date").agg(F.sum("n").alias("n")).withColumn("ask", F.lit(0)).unionAll(dates.select("date", F.lit(0).cast("long"), F.lit(1)))
    w = Window.orderBy("date", "ask").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return by_day.withColumn("members", F.sum("n").over(w)).where("ask = 1").select("date", "members")


def survivorship(panel: DataFrame, lives: DataFrame, inclusive_delist: bool = True) -> DataFrame:
    """Rows of the panel that no lifecycle allows, with the reason."""
    d = F.col("date")
    late = (d > F.col("delist_date")) if inclusive_delist else (d >= F.col("delist_date"))
    reason = F.when(F.col("list_date").isNull(), "unknown").when(d < F.col("list_date"), "before_listing").when(late, "after_delisting")
    return panel.join(lives.select("code", "list_date", "delist_date"), "code", "left").select("date", "code", reason.alias("reason")).where("reason IS NOT NULL")


def compare(a: DataFrame, b: DataFrame, key: str = "code") -> DataFrame:
    """One row: keys in both, in one alone, and their Jaccard likeness."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    n = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("overlap"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    return n.withColumn("jaccard", sdiv("overlap", F.col("overlap") + F.col("only_a") + F.col("only_b")))


def adjustment(panel: DataFrame, actions: DataFrame) -> DataFrame:
    """panel with `factor`: the product of (code, ex_date, ratio) up to each date, as a running product after one shuffle by code."""
    w = Window.partitionBy("code").orderBy("date", "__side").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in panel.columns if c not in ("code", "date")]
    both = panel.select("code", "date", F.lit(1).alias("__side"), F.struct(*rest).alias("__row"), F.lit(1.0).alias("__r")).unionByName(actions.select("code", F.col("ex_date").alias("date"), F.lit(0).alias("__side"), F.col("ratio").alias("__r")), allowMissingColumns=True)
    return both.withColumn("factor", F.product("__r").over(w)).where("__side = 1").select("code", "date", *[F.col("__row")[c].alias(c) for c in rest], "factor")
