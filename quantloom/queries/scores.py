"""Scan, score, audit and streaming (batch form) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.num import sdiv
from ..functions.windows import roll_mean
from ..operators import portfolio as pf
from ..operators import validate as va
from ..sources import tables as src
from ..streaming import bars as st
from .registry import bars, facts, fills, query, r6, rounded

W = "WINDOW w AS (PARTITION BY code ORDER BY date)"
SPOT = """spot AS (SELECT code, date, market_cap, close / nullif(lag(close) OVER w, 0) - 1 AS change, volume / nullif(CASE WHEN count(volume) OVER t >= 20 THEN avg(volume) OVER t END, 0) AS volume_ratio,
CAST(volume % 60 AS DOUBLE) AS pe FROM bars WINDOW w AS (PARTITION BY code ORDER BY date), t AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
scored AS (SELECT *, CASE WHEN change > 0.05::DOUBLE THEN 40 WHEN change > 0 THEN 25 ELSE 0 END + CASE WHEN volume_ratio > 1.5::DOUBLE THEN 30 WHEN volume_ratio > 1 THEN 15 ELSE 0 END + CASE WHEN pe BETWEEN 0 AND 20 THEN 30 WHEN pe BETWEEN 0 AND 40 THEN 15 ELSE 0 END AS score FROM spot)"""


def _spot(spark, sf):
    from ..functions.windows import lag

    b = bars(spark, sf)
    s = b.select("code", "date", "market_cap", (sdiv("close", lag("close")) - 1).alias("change"), sdiv("volume", roll_mean("volume", 20)).alias("volume_ratio"), (F.col("volume") % 60).alias("pe"))
    return s.withColumn("score", pf.opportunity_score())


@query(f"WITH {SPOT} SELECT code, date, CAST(score AS INT) AS score FROM scored WHERE date = (SELECT max(date) FROM bars WHERE date <= DATE '2000-06-01') AND (pe > 0 AND pe <= 50) ORDER BY score DESC, code LIMIT 10", "bars")
def scanner_topn(spark, sf):
    s = _spot(spark, sf)
    day = s.where("date <= '2000-06-01'").agg(F.max("date").alias("date"))
    return pf.scan(s.join(day, "date"), 10, most_pe=50).select("code", "date", F.col("score").cast("int").alias("score"))


@query(f"WITH {SPOT} SELECT code, date, CAST(score AS INT) AS score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade FROM scored", "bars")
def score_classify(spark, sf):
    return _spot(spark, sf).select("code", "date", F.col("score").cast("int").alias("score"), pf.grade("score").alias("grade"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce((quantity + 2 - l_linenumber - 3) / nullif(quantity + 2 + l_linenumber + 3, 0), 0),6)+0.0 AS pressure FROM fills", "fills")
def book_pressure(spark, sf):
    f = fills(spark, sf)
    p = pf.book_pressure(F.array("quantity", F.lit(2.0)), F.array(F.col("l_linenumber").cast("double"), F.lit(3.0)))
    return rounded(f, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pressure=p)


FLOW = "SELECT l_partkey, round(bought,4)+0.0 AS bought, round(sold,4)+0.0 AS sold, round(coalesce((bought - sold) / nullif(bought + sold, 0), 0),6)+0.0 AS net_ratio FROM (SELECT l_partkey, coalesce(sum(price * quantity) FILTER (side = 'buy'), 0) AS bought, coalesce(sum(price * quantity) FILTER (side = 'sell'), 0) AS sold FROM fills {} GROUP BY l_partkey)"


def _flow(df):
    return df.select("l_partkey", *[(F.round(c, 4) + 0.0).alias(c) for c in ("bought", "sold")], r6("net_ratio").alias("net_ratio"))


@query(FLOW.format(""), "fills")
def capital_flow_score(spark, sf):
    return _flow(pf.flow(fills(spark, sf), "l_partkey"))


@query(FLOW.format("WHERE price * quantity > 50000"), "fills")
def main_force_score(spark, sf):
    return _flow(pf.flow(fills(spark, sf), "l_partkey", 50000.0))


@query(
    """WITH b AS (SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS w, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, o_orderstatus) AS k, sum(n) OVER (PARTITION BY o_custkey) AS votes, sum(w) OVER (PARTITION BY o_custkey) AS total FROM b)
    SELECT o_custkey, CAST(votes AS BIGINT) AS votes, o_orderstatus AS winner, round(w / total,6)+0.0 AS share FROM r WHERE k = 1"""
)
def vote_count(spark, sf):
    return rounded(pf.votes(src.table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_totalprice"), "o_custkey", "votes", "winner", share="share")


@query("SELECT count(c_acctbal) AS n, round(count(*) FILTER (c_acctbal > 0) / count(c_acctbal),6)+0.0 AS win_rate, round(avg(c_acctbal),6)+0.0 AS mean, round(avg(c_acctbal) FILTER (c_acctbal > 0),6)+0.0 AS mean_win, round(avg(c_acctbal) FILTER (c_acctbal < 0),6)+0.0 AS mean_loss FROM customer")
def review_stats(spark, sf):
    return rounded(pf.review(src.table(spark, sf, "customer"), "c_acctbal"), "n", win_rate="win_rate", mean="mean", mean_win="mean_win", mean_loss="mean_loss")


# audits
LOOK = "l AS (SELECT report_period AS signal_date, available_date, CASE WHEN fact_id % 7 <> 0 THEN report_period + CAST(fact_id % 4 AS INT) END AS entry_date, report_period + CAST(fact_id % 6 AS INT) AS exit_date FROM facts)"
CHECKS = {"known_after_signal": "available_date > signal_date", "entry_not_after_signal": "entry_date <= signal_date", "exit_not_after_entry": "exit_date <= entry_date", "no_known_date": "available_date IS NULL", "no_entry": "entry_date IS NULL"}


@query(f"WITH {LOOK} " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER ({v}) AS violations FROM l" for k, v in CHECKS.items()), "facts")
def lookahead_audit(spark, sf):
    k = F.col("fact_id")
    f = facts(spark, sf).select(F.col("report_period").alias("signal_date"), "available_date", F.when(k % 7 != 0, F.date_add("report_period", (k % 4).cast("int"))).alias("entry_date"), F.date_add("report_period", (k % 6).cast("int")).alias("exit_date"))
    return va.look_ahead(f)


@query(
    """WITH m AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) < lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS back FROM orders)
    SELECT code, count(*) AS n, count(*) FILTER (back) AS backward, count(date) - count(DISTINCT date) AS repeated FROM m GROUP BY code HAVING count(*) FILTER (back) > 0 OR count(date) > count(DISTINCT date)"""
)
def temporal_audit(spark, sf):
    return va.temporal(src.table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("seq")))


@query(
    """WITH t AS (SELECT c_custkey % 50 AS split, 'p' || CAST(c_custkey % 3 AS VARCHAR) AS part, DATE '2020-01-01' + CAST(min(c_custkey) % 20 AS INT) AS first_day, DATE '2020-01-01' + CAST(min(c_custkey) % 20 + 12 AS INT) AS last_day FROM customer GROUP BY ALL)
    SELECT x.split, x.part AS a, y.part AS b, CAST(least(x.last_day, y.last_day) - greatest(x.first_day, y.first_day) + 1 AS INT) AS days FROM t x JOIN t y ON x.split = y.split AND x.part < y.part AND x.first_day <= y.last_day AND y.first_day <= x.last_day"""
)
def split_overlap_audit(spark, sf):
    day = F.lit("2020-01-01").cast("date")
    c = src.table(spark, sf, "customer").groupBy((F.col("c_custkey") % 50).alias("split"), F.concat(F.lit("p"), (F.col("c_custkey") % 3).cast("string")).alias("part")).agg((F.min("c_custkey") % 20).cast("int").alias("k"))
    return va.split_overlaps(c.select("split", "part", F.date_add(day, F.col("k")).alias("first_day"), F.date_add(day, F.col("k") + 12).alias("last_day")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negative FROM facts" for c in ("net_profit", "total_assets", "equity", "pe")), "facts")
def data_quality_audit(spark, sf):
    return va.data_quality(facts(spark, sf), ["net_profit", "total_assets", "equity", "pe"])


# streaming operators over a batch
def _ticks(spark, sf):
    return st.ticks(src.table(spark, sf, "events"))


@query("SELECT user_id AS code, max(ts) AS ts, round(last(value ORDER BY ts, event_id),6)+0.0 AS price FROM events GROUP BY user_id")
def latest_tick(spark, sf):
    return st.latest(_ticks(spark, sf)).select("code", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("price").alias("price"))


@query("SELECT user_id AS code, date_trunc('day', ts) AS start, round(first(value ORDER BY ts, event_id),6)+0.0 AS open, round(max(value),6)+0.0 AS high, round(min(value),6)+0.0 AS low, round(last(value ORDER BY ts, event_id),6)+0.0 AS close, count(*) AS n FROM events GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY user_id, date_trunc('day', ts)"))
def windowed_bars(spark, sf):
    b = st.bars(_ticks(spark, sf))
    return b.select("code", F.to_date("start").cast("timestamp_ntz").alias("start"), *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "n")


@query(
    """WITH g AS (SELECT user_id AS code, ts, value, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR, true) AS new FROM events))
    SELECT code, min(ts) AS start, count(*) AS n, round(sum(value),6)+0.0 AS total FROM g GROUP BY code, s"""
)
def tick_sessions(spark, sf):
    return st.sessions(_ticks(spark, sf)).select("code", F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("total").alias("total"))


@query(
    """WITH k AS (SELECT user_id AS code, ts, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS nth FROM events)
    SELECT code, nth, max(ts) AS last_ts, round(avg(value),6)+0.0 AS mean FROM k GROUP BY code, nth HAVING count(*) = 3"""
)
def every_three_trigger(spark, sf):
    return st.every(_ticks(spark, sf)).select("code", "nth", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), r6("mean").alias("mean"))


@query("SELECT user_id AS code, CAST(nth AS INT) AS nth, ts, event_id, round(value,6)+0.0 AS price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5")
def recent_ticks(spark, sf):
    return st.recent(_ticks(spark, sf), 5).select("code", "nth", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", r6("price").alias("price"))


@query("SELECT event_id, user_id AS code, CASE WHEN value > 40 THEN 'price' ELSE 'error' END AS reason FROM events WHERE value > 40 OR event_type = 'error'")
def anomaly_alerts(spark, sf):
    return st.alerts(_ticks(spark, sf), 40.0).select("event_id", "code", "reason")


