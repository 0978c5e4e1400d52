"""Point-in-time and universe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pit as op
from ..sources import tables as src
from .registry import bars, facts, lives, query, r6, rounded


@query(
    """SELECT b.code, b.date, round(b.close,6)+0.0 AS close, round(f.revenue,6)+0.0 AS revenue, round(f.roe,6)+0.0 AS roe FROM bars b ASOF LEFT JOIN
    (SELECT code, available_date, arg_max(revenue, fact_id) AS revenue, arg_max(roe, fact_id) AS roe FROM facts WHERE available_date IS NOT NULL GROUP BY code, available_date) f ON b.code = f.code AND b.date >= f.available_date""",
    "bars", "facts",
)
def pit_asof_join(spark, sf):
    return rounded(op.as_of_join(bars(spark, sf).select("code", "date", "close"), facts(spark, sf), ["revenue", "roe"]), "code", "date", close="close", revenue="revenue", roe="roe")


@query("SELECT code, fact_id, available_date, round(revenue,6)+0.0 AS revenue FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY available_date DESC, fact_id DESC) AS k FROM facts WHERE available_date <= DATE '1998-06-30') WHERE k = 1", "facts")
def pit_latest(spark, sf):
    return op.latest(facts(spark, sf), "1998-06-30").select("code", "fact_id", "available_date", r6("revenue").alias("revenue"))


@query(
    """WITH d AS (SELECT DISTINCT date FROM bars) SELECT d.date, f.code, arg_max(f.fact_id, (f.available_date, f.fact_id)) AS fact_id
    FROM d JOIN facts f ON f.available_date <= d.date GROUP BY d.date, f.code""",
    "bars", "facts",
)
def pit_panel(spark, sf):
    dates = bars(spark, sf).select("date").distinct()
    f = facts(spark, sf)
    return op.snapshots(dates, f.withColumn("known_id", F.col("fact_id")), ["known_id"]).select("date", "code", F.col("known_id").alias("fact_id"))


@query("SELECT fact_id, code, available_date FROM facts WHERE available_date > report_period", "facts")
def pit_violations(spark, sf):
    return op.look_ahead(facts(spark, sf).withColumn("date", F.col("report_period"))).select("fact_id", "code", "available_date")


@query("SELECT fact_id, code FROM facts WHERE available_date <= DATE '1997-01-01' OR available_date IS NULL", "facts")
def pit_filter(spark, sf):
    return op.known_as_of(facts(spark, sf), "1997-01-01", keep_unknown=True).select("fact_id", "code")


@query(
    """SELECT fact_id, coalesce(available_date, announcement_date, report_period) AS known_date, CASE WHEN available_date IS NOT NULL THEN 'explicit' WHEN announcement_date IS NOT NULL THEN 'announcement' WHEN report_period IS NOT NULL THEN 'report_period' ELSE 'unknown' END AS availability_type,
    CASE WHEN available_date IS NOT NULL THEN 'high' WHEN announcement_date IS NOT NULL THEN 'medium' WHEN report_period IS NOT NULL THEN 'low' ELSE 'none' END AS confidence FROM facts""",
    "facts",
)
def availability_resolve(spark, sf):
    return op.availability(facts(spark, sf)).select("fact_id", "known_date", "availability_type", "confidence")


@query(
    """SELECT count(*) AS n_rows, round(avg(CASE WHEN available_date IS NOT NULL THEN 1.0 ELSE 0 END),6)+0.0 AS explicit_share, round(avg(CASE WHEN available_date IS NULL AND announcement_date IS NOT NULL THEN 1.0 ELSE 0 END),6)+0.0 AS announcement_share,
    round(avg(CASE WHEN available_date IS NULL AND announcement_date IS NULL AND report_period IS NOT NULL THEN 1.0 ELSE 0 END),6)+0.0 AS report_period_share FROM facts""",
    "facts",
)
def availability_audit(spark, sf):
    return rounded(op.audit(facts(spark, sf)), "n_rows", explicit_share="explicit_share", announcement_share="announcement_share", report_period_share="report_period_share")


@query("SELECT code, list_date, is_st FROM lives WHERE list_date <= DATE '1998-01-01' AND (delist_date IS NULL OR DATE '1998-01-01' < delist_date)", "lives")
def universe_as_of(spark, sf):
    return op.universe(lives(spark, sf), "1998-01-01").select("code", "list_date", "is_st")


@query("WITH d AS (SELECT DISTINCT date FROM bars) SELECT d.date, count(l.code) AS members FROM d LEFT JOIN lives l ON l.list_date <= d.date AND (l.delist_date IS NULL OR d.date < l.delist_date) GROUP BY d.date", "bars", "lives")
def universe_sizes(spark, sf):
    return op.universe_sizes(lives(spark, sf), bars(spark, sf).select("date").distinct())


@query(
    """WITH a AS (SELECT code FROM lives WHERE list_date <= DATE '1997-01-01' AND (delist_date IS NULL OR DATE '1997-01-01' < delist_date)), b AS (SELECT code FROM lives WHERE list_date <= DATE '2001-08-01' AND (delist_date IS NULL OR DATE '2001-08-01' < delist_date)),
    c AS (SELECT (SELECT count(*) FROM a JOIN b USING (code)) AS o, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb) SELECT o AS overlap, na - o AS only_a, nb - o AS only_b, round(o / nullif(na + nb - o, 0),6)+0.0 AS jaccard FROM c""",
    "lives",
)
def universe_compare(spark, sf):
    x = lives(spark, sf)
    return rounded(op.compare(op.universe(x, "1997-01-01"), op.universe(x, "2001-08-01")), "overlap", "only_a", "only_b", jaccard="jaccard")


def _orders(spark, sf):
    from ..functions.num import security_code

    return src.table(spark, sf, "orders").select(security_code(F.col("o_custkey") + 1).alias("code"), F.to_date("o_orderdate").alias("date"))


@query(
    """SELECT date, code, reason FROM (SELECT o.date, o.code, CASE WHEN l.list_date IS NULL THEN 'unknown' WHEN o.date < l.list_date THEN 'before_listing' WHEN o.date > l.delist_date THEN 'after_delisting' END AS reason
    FROM (SELECT lpad(CAST(o_custkey + 1 AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS date FROM orders) o LEFT JOIN lives l USING (code)) WHERE reason IS NOT NULL""",
    "lives",
)
def survivorship_audit(spark, sf):
    return op.survivorship(_orders(spark, sf), lives(spark, sf))


@query("SELECT DISTINCT code, date FROM (SELECT lpad(CAST(o_custkey + 1 AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS date FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.code = o.code)", "lives")
def membership_anti_join(spark, sf):
    return _orders(spark, sf).join(lives(spark, sf).select("code"), "code", "left_anti").distinct()


@query(
    """WITH a AS (SELECT code, report_period AS ex_date, 1 + (fact_id % 3) / 100000 AS ratio FROM facts)
    SELECT b.code, b.date, round(exp(coalesce(sum(ln(a.ratio)), 0)),6)+0.0 AS factor FROM bars b LEFT JOIN a ON a.code = b.code AND a.ex_date <= b.date GROUP BY b.code, b.date""",
    "bars", "facts",
)
def corporate_action_factor(spark, sf):
    actions = facts(spark, sf).select("code", F.col("report_period").alias("ex_date"), (1 + (F.col("fact_id") % 3) / 100000.0).alias("ratio"))
    return rounded(op.adjustment(bars(spark, sf).select("code", "date"), actions), "code", "date", factor="factor")
