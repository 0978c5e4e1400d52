"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PRICE = "l_extendedprice / l_quantity"
_AT = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
#: Views of src in SQL; a query's SQL names those it needs.
VIEWS = {
    "bars": f"""SELECT code, date, open, high, low, close, volume, amount, 'I' || CAST(k % 5 AS VARCHAR) AS industry, amount * (k % 7 + 1) AS market_cap
      FROM (SELECT p_brand AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, first({_PRICE} ORDER BY {_AT}) AS open, max({_PRICE}) AS high, min({_PRICE}) AS low,
      last({_PRICE} ORDER BY {_AT}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS k
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, CAST(date_trunc('week', l_shipdate) AS DATE))""",
    "days": """SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
      last(value ORDER BY ts, event_id) AS close, count(*) AS volume, sum(value) AS amount FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "facts": """SELECT o_orderkey AS fact_id, 'Brand#' || CAST(o_custkey % 25 AS VARCHAR) AS code, CAST(o_orderdate AS DATE) AS report_period,
      CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INT) END AS available_date,
      CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INT) END AS announcement_date,
      o_totalprice AS revenue, o_totalprice * ((o_orderkey % 21) - 5) / 100 AS net_profit, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice * ((o_custkey % 9) + 1) END AS total_assets,
      o_totalprice * (o_orderkey % 5) AS equity, CAST((o_orderkey % 50) - 5 AS DOUBLE) AS pe, (o_custkey % 20) / 4 AS pb, (o_orderkey % 17) / 3 AS ps,
      (o_orderkey % 40) / 100 - 0.05::DOUBLE AS roe, (o_custkey % 30) / 100 AS roic, (o_orderkey % 33) / 100 - 0.1::DOUBLE AS revenue_growth,
      (o_orderkey % 27) / 100 - 0.1::DOUBLE AS profit_growth, o_totalprice * 10 AS market_cap FROM orders""",
    "lives": """SELECT code, list_date, CASE WHEN last_date < DATE '2001-06-01' THEN last_date END AS delist_date, n % 7 = 0 AS is_st FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code,
      CAST(min(o_orderdate) AS DATE) AS list_date, CAST(max(o_orderdate) AS DATE) AS last_date, count(*) AS n FROM orders GROUP BY o_custkey)""",
    "fills": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_PRICE} AS price, l_quantity AS quantity, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side FROM lineitem""",
    # a signal (three-week momentum) and the next week's return
    "signals": """SELECT code, date, industry, market_cap, close / nullif(lag(close, 3) OVER w, 0) - 1 AS signal, lead(close) OVER w / nullif(lead(open) OVER w, 0) - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)""",
}
_NEEDS = {"signals": ["bars"]}


def query(sql: str | None = None, *views: str, name: str | None = None, recursive: bool = False):
    """Registers a query; sql follows the named views."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            order: list[str] = []
            for v in views:
                order += [x for x in (*_NEEDS.get(v, []), v) if x not in order]
            head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
            body = sql.strip()
            if head:
                body = f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
            SQL[key] = body.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else body
        return fn

    return add


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.brand_bars(src.table(spark, sf_dir, "lineitem"), src.table(spark, sf_dir, "part"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_bars(src.table(spark, sf_dir, "events"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.fundamentals(src.table(spark, sf_dir, "orders"))


def lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.lifecycles(src.table(spark, sf_dir, "orders"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.trades(src.table(spark, sf_dir, "lineitem"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.num import sdiv
    from ..functions.windows import lag, lead

    return bars(spark, sf_dir).select("code", "date", "industry", "market_cap", (sdiv("close", lag("close", 3)) - 1).alias("signal"), (sdiv(lead("close"), lead("open")) - 1).alias("fwd"))


def r6(x: str | Column) -> Column:
    """Rounded for comparison with another engine; no negative zero."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str, **made: str | Column) -> DataFrame:
    return df.select(*keep, *[r6(v).alias(k) for k, v in made.items()])
