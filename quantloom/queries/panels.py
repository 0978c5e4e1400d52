"""Panel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.num import exchange_code, percent, security_code
from ..operators import panel as op
from ..sources import tables as src
from .registry import bars, days, query, r6, rounded

W = "WINDOW w AS (PARTITION BY code ORDER BY date)"


@query("SELECT code, date, round(open,6)+0.0 AS open, round(high,6)+0.0 AS high, round(low,6)+0.0 AS low, round(close,6)+0.0 AS close, CAST(volume AS BIGINT) AS volume, round(amount,6)+0.0 AS amount FROM days", "days")
def event_bars(spark, sf):
    return days(spark, sf).select("code", "date", *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "volume", r6("amount").alias("amount"))


@query("SELECT code, date, round(open,6)+0.0 AS open, round(high,6)+0.0 AS high, round(low,6)+0.0 AS low, round(close,6)+0.0 AS close, round(volume,6)+0.0 AS volume, round(amount,6)+0.0 AS amount, industry FROM bars", "bars")
def brand_bars(spark, sf):
    return bars(spark, sf).select("code", "date", *[r6(c).alias(c) for c in ("open", "high", "low", "close", "volume", "amount")], "industry")


@query(
    """SELECT code, date, round(close,6)+0.0 AS close, n FROM (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, CAST(ts AS DATE) AS date, value AS close, event_id AS n,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS k FROM events) WHERE k = 1"""
)
def normalize_keep_last(spark, sf):
    raw = src.table(spark, sf, "events").select(F.col("user_id").alias("symbol"), F.col("ts").alias("trade_date"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).alias("vol"), F.col("event_id").alias("n"))
    return src.normalize(raw, "n").select("code", "date", r6("close").alias("close"), "n")


@query("SELECT code, date, round(close,6)+0.0 AS close FROM days WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'", "days")
def panel_between(spark, sf):
    return rounded(op.between(days(spark, sf), "2024-01-05", "2024-01-12"), "code", "date", close="close")


@query("SELECT code, date, round(close,6)+0.0 AS close, volume FROM days WHERE date = DATE '2024-01-10'", "days")
def cross_section(spark, sf):
    return op.cross_section(days(spark, sf), "2024-01-10").select("code", "date", r6("close").alias("close"), "volume")


@query("SELECT code, date, round(close,6)+0.0 AS close FROM days WHERE code IN ('000001', '000007')", "days")
def select_codes(spark, sf):
    return rounded(days(spark, sf).where(F.col("code").isin("000001", "000007")), "code", "date", close="close")


@query("SELECT date, count(DISTINCT code) AS n_codes, CAST(sum(CASE WHEN volume > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_tradeable FROM days GROUP BY date", "days")
def daily_stock_count(spark, sf):
    return days(spark, sf).groupBy("date").agg(F.count_distinct("code").alias("n_codes"), F.count_if(F.col("volume") > 1).alias("n_tradeable"))


@query("SELECT code, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM days GROUP BY code", "days")
def coverage_by_code(spark, sf):
    return days(spark, sf).groupBy("code").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT code) AS n_codes, count(DISTINCT date) AS n_dates, CAST(sum(n - 1) AS BIGINT) AS n_repeated, CAST(sum(m) AS BIGINT) AS n_no_close, CAST(sum(z) AS BIGINT) AS n_no_volume
    FROM (SELECT user_id AS code, CAST(ts AS DATE) AS date, count(*) AS n, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS m, sum(CASE WHEN coalesce(value, 0) <= 0 THEN 1 ELSE 0 END) AS z FROM events GROUP BY ALL)"""
)
def quality_report(spark, sf):
    return op.quality(src.table(spark, sf, "events").select(F.col("user_id").alias("code"), F.to_date("ts").alias("date"), F.col("value").alias("close"), F.col("value").alias("volume")))


@query("SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS ordinal FROM (SELECT DISTINCT date FROM bars)", "bars")
def trading_day_index(spark, sf):
    return op.calendar(bars(spark, sf))


@query("WITH c AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)) SELECT a.date, b.date AS shifted FROM c a LEFT JOIN c b ON b.i = a.i + 3", "bars")
def calendar_shift(spark, sf):
    days_ = op.calendar(bars(spark, sf))
    return op.shift_days(days_.select("date"), days_, 3)


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT d.date, max(b.date) AS previous FROM d LEFT JOIN (SELECT DISTINCT date FROM bars) b ON b.date <= d.date GROUP BY d.date", "bars")
def calendar_previous(spark, sf):
    dates = src.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return op.previous_day(dates, op.calendar(bars(spark, sf)))


@query(f"SELECT code, date, round(close / nullif(lag(close, 1) OVER w, 0) - 1,6)+0.0 AS return_1, round(close / nullif(lag(close, 5) OVER w, 0) - 1,6)+0.0 AS return_5 FROM bars {W}", "bars")
def add_returns(spark, sf):
    return rounded(op.returns(bars(spark, sf), 1, 5), "code", "date", return_1="return_1", return_5="return_5")


@query(f"SELECT code, date, round(lead(close, 5) OVER w / nullif(close, 0) - 1,6)+0.0 AS fwd5, round(lead(close) OVER w / nullif(lead(open) OVER w, 0) - 1,6)+0.0 AS next_open, round(lead(close, 3) OVER w / nullif(lead(open) OVER w, 0) - 1,6)+0.0 AS open_close_3, round(lead(open, 2) OVER w / nullif(lead(open) OVER w, 0) - 1,6)+0.0 AS open_open FROM bars {W}", "bars")
def forward_returns(spark, sf):
    return rounded(bars(spark, sf), "code", "date", fwd5=op.forward_return(5), next_open=op.next_open_return(), open_close_3=op.open_to_close(3), open_open=op.open_to_open())


@query("SELECT code, date, round(max(high) OVER f / nullif(close, 0) - 1,6)+0.0 AS forward_max, round(min(low) OVER f / nullif(close, 0) - 1,6)+0.0 AS forward_drawdown FROM bars WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)", "bars")
def forward_extremes(spark, sf):
    return rounded(bars(spark, sf), "code", "date", forward_max=op.forward_max(5), forward_drawdown=op.forward_drawdown(5))


@query("SELECT code, date, round(fwd - avg(fwd) OVER (PARTITION BY date),6)+0.0 AS excess FROM signals WHERE fwd IS NOT NULL", "signals")
def excess_return(spark, sf):
    from .registry import signals

    return rounded(signals(spark, sf).where("fwd IS NOT NULL"), "code", "date", excess=op.excess())


@query(
    f"""SELECT code, date, coalesce(close >= floor(p * 1.1::DOUBLE * 100 + 0.5::DOUBLE) / 100 - 0.011::DOUBLE, false) AS limit_up, coalesce(close <= floor(p * 0.9::DOUBLE * 100 + 0.5::DOUBLE) / 100 + 0.011::DOUBLE, false) AS limit_down
    FROM (SELECT code, date, close, lag(close) OVER w AS p FROM bars {W})""",
    "bars",
)
def limit_flags(spark, sf):
    return op.limit_flags(bars(spark, sf)).select("code", "date", "limit_up", "limit_down")


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, lpad(CAST(c_custkey AS VARCHAR), 6, '0') || CASE WHEN regexp_matches(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '^[69]') THEN '.SH' WHEN regexp_matches(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '^[48]') THEN '.BJ' ELSE '.SZ' END AS listed, round(c_acctbal / 100,6)+0.0 AS share FROM customer")
def code_normalizers(spark, sf):
    return src.table(spark, sf, "customer").select("c_custkey", security_code("c_custkey").alias("code"), exchange_code("c_custkey").alias("listed"), r6(percent(F.concat(F.format_string("%.2f", "c_acctbal"), F.lit("%")))).alias("share"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN least(open, high, low, close) <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_price, CAST(sum(CASE WHEN high < greatest(open, low, close) OR low > least(open, close) THEN 1 ELSE 0 END) AS BIGINT) AS bad_range FROM days", "days")
def panel_violations(spark, sf):
    d = days(spark, sf).withColumn("available_date", F.col("date"))
    return src.violations(d).select("bad_price", "bad_range").join(d.agg(F.count(F.lit(1)).alias("n"))).select("n", "bad_price", "bad_range")
