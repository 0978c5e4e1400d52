"""Further queries: lags, recomputation checks, registries, long facts, rank correlations, parameter grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import average_rank, lag, roll_mean, scorr
from ..operators import metrics as me
from ..operators import transforms as tr
from ..sources import tables as src
from .factors import _roll, rank_sql
from .registry import bars, facts, query, r6, rounded, signals
from .signals import CORR

W = "WINDOW w AS (PARTITION BY code ORDER BY date)"


@query(f"SELECT code, date, round(lag(signal) OVER w,6)+0.0 AS signal FROM signals {W}", "signals")
def lag_signal(spark, sf):
    return rounded(signals(spark, sf), "code", "date", signal=lag("signal"))


MEAN = _roll("avg", "close", 20)


@query(f"WITH s AS (SELECT code, date, close, {MEAN} AS good, {MEAN} + CASE WHEN day(date) = 13 THEN 1 ELSE 0 END AS stored FROM bars) SELECT code, date FROM s WHERE abs(stored - good) > 1e-10", "bars")
def rolling_safety_check(spark, sf):
    """Rows whose stored rolling mean isn't what the rows up to them give."""
    b = bars(spark, sf).withColumn("good", roll_mean("close", 20))
    stored = b.withColumn("stored", F.col("good") + F.when(F.dayofmonth("date") == 13, 1.0).otherwise(0.0))
    return stored.where(F.abs(F.col("stored") - F.col("good")) > 1e-10).select("code", "date")


@query("SELECT event_type AS status, count(*) AS n, max(ts) AS last_ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY event_type")
def registry_statistics(spark, sf):
    """Latest states of an append-only table of changes, counted."""
    e = src.table(spark, sf, "events")
    latest = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("r")).select("r.*")
    return latest.groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@query("SELECT fact_id, code, 'revenue' AS field, round(revenue,6)+0.0 AS value FROM facts WHERE revenue IS NOT NULL UNION ALL SELECT fact_id, code, 'total_assets', round(total_assets,6)+0.0 FROM facts WHERE total_assets IS NOT NULL UNION ALL SELECT fact_id, code, 'roe', round(roe,6)+0.0 FROM facts WHERE roe IS NOT NULL", "facts")
def facts_long(spark, sf):
    long = facts(spark, sf).select("fact_id", "code", "revenue", "total_assets", "roe").unpivot(["fact_id", "code"], ["revenue", "total_assets", "roe"], "field", "value")
    return long.where("value IS NOT NULL").select("fact_id", "code", "field", r6("value").alias("value"))


@query(
    """WITH l AS (SELECT code, 'revenue' AS field, report_period, available_date, fact_id, revenue AS value FROM facts UNION ALL SELECT code, 'roe', report_period, available_date, fact_id, roe FROM facts)
    SELECT code, field, round(value,6)+0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY code, field ORDER BY report_period DESC, available_date DESC, fact_id DESC) AS k FROM l WHERE available_date <= DATE '1999-03-31') WHERE k = 1""",
    "facts",
)
def pit_key_query(spark, sf):
    """Each (code, field) as known on a day: the last period, of equal ones the last known."""
    long = facts(spark, sf).unpivot(["code", "report_period", "available_date", "fact_id"], ["revenue", "roe"], "field", "value")
    known = long.where(F.col("available_date") <= F.lit("1999-03-31").cast("date"))
    return known.groupBy("code", "field").agg(r6(F.max_by("value", F.struct("report_period", "available_date", "fact_id"))).alias("value"))


@query(f"WITH k AS (SELECT code, {rank_sql('close', 'code')} AS a, {rank_sql('volume', 'code')} AS b FROM bars) SELECT code, round({CORR.format('a', 'b')},6)+0.0 AS rho FROM k GROUP BY code", "bars")
def spearman_by_code(spark, sf):
    b = bars(spark, sf).select("code", average_rank("close", "code").alias("a"), average_rank("volume", "code").alias("b"))
    return b.groupBy("code").agg(r6(F.round(scorr(F.col("a"), F.col("b")), 12)).alias("rho"))


@query(
    f"""WITH m AS (SELECT code, date, close, lead(close) OVER w / nullif(lead(open) OVER w, 0) - 1 AS fwd, lag(close, 1) OVER w AS l1, lag(close, 4) OVER w AS l4, lag(close, 12) OVER w AS l12 FROM bars {W}),
    x AS (SELECT 1 AS span, date, close / nullif(l1, 0) - 1 AS s, fwd FROM m UNION ALL SELECT 4, date, close / nullif(l4, 0) - 1, fwd FROM m UNION ALL SELECT 12, date, close / nullif(l12, 0) - 1, fwd FROM m),
    k AS (SELECT span, date, {rank_sql('s', 'span, date')} AS a, {rank_sql('fwd', 'span, date')} AS b FROM x WHERE s IS NOT NULL AND fwd IS NOT NULL), d AS (SELECT span, date, CASE WHEN count(*) >= 5 THEN {CORR.format('a', 'b')} END AS ic FROM k GROUP BY span, date)
    SELECT CAST(span AS INT) AS span, round(avg(ic),6)+0.0 AS ic FROM d GROUP BY span""",
    "bars",
)
def parameter_search(spark, sf):
    """A grid of momentum spans by mean rank correlation: all spans in one job."""
    from ..functions.num import sdiv
    from ..functions.windows import lead

    b = bars(spark, sf).select("code", "date", (sdiv(lead("close"), lead("open")) - 1).alias("fwd"), *[(sdiv("close", lag("close", k)) - 1).alias(f"m{k}") for k in (1, 4, 12)])
    long = b.select("date", "fwd", F.explode(F.array(*[F.struct(F.lit(k).alias("span"), F.col(f"m{k}").alias("s")) for k in (1, 4, 12)])).alias("x")).select("date", "fwd", "x.*").where("s IS NOT NULL AND fwd IS NOT NULL")
    ranks = long.select("span", "date", average_rank("s", "span", "date").alias("a"), average_rank("fwd", "span", "date").alias("b"))
    daily = ranks.groupBy("span", "date").agg(F.when(F.count(F.lit(1)) >= 5, F.round(scorr(F.col("a"), F.col("b")), 12)).alias("ic"))
    return daily.groupBy("span").agg(r6(F.avg("ic")).alias("ic"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE NOT regexp_matches(s_name, '(?i)st|0{8}') AND s_acctbal > 0")
def name_filter(spark, sf):
    """Names without marks of special treatment, balances above 0."""
    return src.table(spark, sf, "supplier").where("NOT s_name RLIKE '(?i)st|0{8}' AND s_acctbal > 0").select("s_suppkey", "s_name")


@query(f"SELECT round({CORR.format('signal', 'fwd')},6)+0.0 AS corr_fwd, round((SELECT {CORR.format('signal', 'market_cap')} FROM signals WHERE signal IS NOT NULL AND market_cap IS NOT NULL),6)+0.0 AS corr_market_cap FROM signals WHERE signal IS NOT NULL AND fwd IS NOT NULL", "signals")
def exposure_check(spark, sf):
    return rounded(tr.exposure(signals(spark, sf), "signal", "fwd", "market_cap"), corr_fwd="corr_fwd", corr_market_cap="corr_market_cap")


@query(
    """WITH p AS (SELECT date, code, signal FROM signals WHERE signal IS NOT NULL), q AS (SELECT date, code, CASE WHEN min(signal) OVER (PARTITION BY date) = max(signal) OVER (PARTITION BY date) THEN 1 ELSE greatest(1, least(5, CAST(ceil(row_number() OVER (PARTITION BY date ORDER BY signal, code) / count(*) OVER (PARTITION BY date) * 5) AS INT))) END AS q FROM p)
    SELECT date, code, round(CASE WHEN q = 5 THEN 0.5 ELSE -0.5 END / count(*) OVER (PARTITION BY date, q),6)+0.0 AS weight FROM q WHERE q IN (1, 5)""",
    "signals",
)
def long_short_weights(spark, sf):
    return rounded(me.equal_weights(signals(spark, sf).where("signal IS NOT NULL"), long_short=True), "date", "code", weight="weight")
