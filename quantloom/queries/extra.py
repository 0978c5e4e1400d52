"""Universe filters, value quantiles, factor sets and runs, stress, optimizers, fitness, leakage and split audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.num import sdiv
from ..operators import factors as fa
from ..operators import fitness as fi
from ..operators import metrics as me
from ..operators import panel as pa
from ..operators import portfolio as pf
from ..operators import transforms as tr
from ..operators import validate as va
from ..sources import tables as src
from .factors import _roll, rank_sql
from .registry import SQL, bars, facts, query, r6, rounded, signals

W = "WINDOW w AS (PARTITION BY code ORDER BY date)"

FLAGS = "(volume >= 100) AS is_tradeable, (close >= open * 1.05::DOUBLE) AS limit_up, (close <= open * 0.95::DOUBLE) AS limit_down, (code LIKE '%3') AS is_st, (volume < 200) AS suspended"


def _flagged(spark, sf):
    return bars(spark, sf).withColumns({"is_tradeable": F.col("volume") >= 100, "limit_up": F.col("close") >= F.col("open") * 1.05, "limit_down": F.col("close") <= F.col("open") * 0.95, "is_st": F.col("code").like("%3"), "suspended": F.col("volume") < 200})


@query(f"WITH f AS (SELECT *, {FLAGS} FROM bars) SELECT code, date, is_tradeable AND NOT suspended AND NOT is_st AS in_universe, is_tradeable AND NOT limit_up AS can_buy, is_tradeable AND NOT limit_down AS can_sell FROM f", "bars")
def universe_mask(spark, sf):
    return _flagged(spark, sf).select("code", "date", pa.in_universe().alias("in_universe"), pa.can_trade("buy").alias("can_buy"), pa.can_trade("sell").alias("can_sell"))


@query(f"WITH f AS (SELECT *, {FLAGS} FROM bars) SELECT date, count(*) AS n FROM f WHERE is_tradeable GROUP BY date", "bars")
def daily_tradeable_count(spark, sf):
    return _flagged(spark, sf).where("is_tradeable").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, round(a,2)+0.0 AS amount FROM (SELECT p_partkey, p_name, p_retailprice, sum(l_extendedprice) AS a FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL) WHERE NOT contains(p_name, 'ST') AND p_retailprice > 0 AND a >= 50000")
def stock_pool(spark, sf):
    amount = src.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_extendedprice").alias("amount"))
    spot = src.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")).join(amount, "p_partkey")
    return pa.stock_pool(spot, 50_000).select("p_partkey", (F.round("amount", 2) + 0.0).alias("amount"))


@query("SELECT user_id, date, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS date, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE k = 1")
def keep_first(spark, sf):
    e = src.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date"), "event_id")
    return src.keep_first(e, ["user_id", "date"], "event_id")


@query("SELECT code, date, CASE WHEN row_number() OVER w <= floor(count(*) OVER (PARTITION BY code) * 0.8::DOUBLE) THEN 'head' ELSE 'tail' END AS part FROM bars " + W, "bars")
def head_tail_split(spark, sf):
    return src.head_tail(bars(spark, sf).select("code", "date"), 0.8)


BY_VALUE = """e AS (SELECT date, list_sort(list_distinct(quantile_cont(signal, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS cuts FROM signals WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY date),
    q AS (SELECT s.date, s.code, s.fwd, len(list_filter(cuts[2:len(cuts) - 1], lambda c: c < s.signal)) + 1 AS q FROM signals s JOIN e USING (date) WHERE signal IS NOT NULL AND fwd IS NOT NULL AND len(cuts) > 1)"""


@query(f"WITH {BY_VALUE} SELECT date, code, CAST(q AS INT) AS q FROM q", "signals")
def quantiles_by_value(spark, sf):
    from ..functions.windows import quantile_by_value

    both = signals(spark, sf).where("signal IS NOT NULL AND fwd IS NOT NULL")
    return both.select("date", "code", quantile_by_value("signal", 5).alias("q")).where("q IS NOT NULL")


@query(f"WITH {BY_VALUE}, m AS (SELECT date, q, avg(fwd) AS m FROM q GROUP BY date, q) SELECT date, count(*) AS buckets, round(CASE WHEN count(*) > 1 THEN arg_max(m, q) - arg_min(m, q) END,6)+0.0 AS spread FROM m GROUP BY date", "signals")
def quantile_spread_value(spark, sf):
    return me.value_quantile_spread(signals(spark, sf)).select("date", "buckets", r6("spread").alias("spread"))


QUANTILES = """p AS (SELECT date, code, signal, fwd FROM signals WHERE signal IS NOT NULL AND fwd IS NOT NULL),
    q AS (SELECT date, fwd, CASE WHEN min(signal) OVER (PARTITION BY date) = max(signal) OVER (PARTITION BY date) THEN 1 ELSE greatest(1, least(5, CAST(ceil(row_number() OVER (PARTITION BY date ORDER BY signal, code) / count(*) OVER (PARTITION BY date) * 5) AS INT))) END AS q FROM p),
    d AS (SELECT date, avg(fwd) FILTER (q = 1) AS q1, avg(fwd) FILTER (q = 2) AS q2, avg(fwd) FILTER (q = 3) AS q3, avg(fwd) FILTER (q = 4) AS q4, avg(fwd) FILTER (q = 5) AS q5 FROM q GROUP BY date)"""


@query(
    f"WITH {QUANTILES} SELECT " + ", ".join(f"round(avg(q{k}),6)+0.0 AS q{k}_mean" for k in range(1, 6)) + ", round(avg(q5 - q1),6)+0.0 AS high_low_mean, round(stddev_samp(q5 - q1),6)+0.0 AS high_low_std, round(avg(q5 - q1) / nullif(stddev_samp(q5 - q1), 0),6)+0.0 AS high_low_ir, round(sum(CASE WHEN q5 - q1 > 0 THEN 1 ELSE 0 END) / count(q5 - q1),6)+0.0 AS high_low_positive FROM d",
    "signals",
)
def quantile_summary(spark, sf):
    s = me.quantile_summary(me.quantile_returns(signals(spark, sf)))
    return rounded(s, **{c: c for c in s.columns})


@query("SELECT count(user_id) AS n, count(DISTINCT user_id) AS \"distinct\", round(count(DISTINCT user_id) / count(user_id),6)+0.0 AS diversity FROM events")
def population_diversity(spark, sf):
    return me.diversity(src.table(spark, sf, "events"), "user_id").select("n", "distinct", r6("diversity").alias("diversity"))


FEATURES = f"""SELECT code, date, close / nullif(lag(close) OVER w, 0) - 1 AS return_1, {_roll('avg', 'close', 5)} AS ma5, {_roll('avg', 'close', 20)} AS ma20, volume / nullif({_roll('avg', 'volume', 20)}, 0) AS volume_change,
    close / nullif(lag(close, 20) OVER w, 0) - 1 AS momentum, CAST(lead(close) OVER w > close AS INT) AS target FROM bars {W}"""


@query(f"WITH f AS ({FEATURES}) SELECT code, date, " + ", ".join(f"round({c},6)+0.0 AS {c}" for c in ("return_1", "ma5", "ma20", "volume_change", "momentum")) + ", target FROM f WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ("return_1", "ma5", "ma20", "volume_change", "momentum", "target")), "bars")
def feature_table(spark, sf):
    return fa.features(bars(spark, sf)).select("code", "date", *[r6(c).alias(c) for c in ("return_1", "ma5", "ma20", "volume_change", "momentum")], "target")


def _default_sql() -> tuple[str, list[str]]:
    one = {
        "momentum": "close / nullif(lag(close, {n}) OVER w, 0) - 1", "reversal": "-(close / nullif(lag(close, {n}) OVER w, 0) - 1)", "high_low_range": "(high - low) / nullif(close, 0)",
        "close_location": "(close - low) / nullif(high - low, 0)", "pvt_change": "pvt - lag(pvt, {n}) OVER w",
    }
    roll = {
        "volatility": ("{r} * sqrt(252)", "stddev_samp", "ret"), "atr": ("{r}", "avg", "tr"), "ma_deviation": ("close / nullif({r}, 0) - 1", "avg", "close"), "volume_ratio": ("volume / nullif({r}, 0)", "avg", "volume"),
        "amount_ratio": ("amount / nullif({r}, 0)", "avg", "amount"), "turnover_mean": ("{r}", "avg", "turnover"), "breakout": ("close / nullif({r}, 0) - 1", "max", "high"), "drawdown": ("close / nullif({r}, 0) - 1", "max", "close"),
    }
    parts, names = [], []
    for k, ns in fa.DEFAULT_SPANS.items():
        for n in ns:
            name = f"{k}_{n}" if n else k
            names.append(name)
            if k == "rsi":
                continue
            sql = one[k].format(n=n) if k in one else roll[k][0].format(r=_roll(roll[k][1], roll[k][2], n))
            parts.append(f"round({sql},6)+0.0 AS {name}")
    base = f"SELECT *, volume / 1000 AS turnover, close / nullif(lag(close) OVER w, 0) - 1 AS ret, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W}"
    volume = "SELECT *, sum(coalesce(volume * ret, 0)) OVER (PARTITION BY code ORDER BY date) AS pvt FROM base0"
    rsi = SQL["rsi_14"]
    own = rsi[rsi.index(" p AS (SELECT code, date, close - lag") + 1 :]
    head, _, last = own.rpartition("SELECT p.code")
    return f"WITH base0 AS ({base}), base1 AS ({volume}), {head.rstrip()}, rs AS (SELECT p.code{last}) SELECT t.*, rs.rsi AS rsi_14 FROM (SELECT code, date, {', '.join(parts)} FROM base1 {W}) t JOIN rs USING (code, date)", names


_SQL25, NAMES25 = _default_sql()


@query(_SQL25, "bars", recursive=True)
def technical_default_set(spark, sf):
    """All twenty-five default factors."""
    return rounded(fa.default_set(bars(spark, sf).withColumn("turnover", F.col("volume") / 1000)), "code", "date", **{c: c for c in NAMES25})


GROWTH = "(SELECT *, date_trunc('month', report_period) AS date, roe - lag(roe) OVER (PARTITION BY code ORDER BY report_period, fact_id) AS roe_growth FROM facts)"
VALUES16 = {
    "earnings_yield": "1 / nullif(pe, 0)", "book_to_market": "1 / nullif(pb, 0)", "sales_yield": "1 / nullif(ps, 0)", "roe": "roe", "roic": "roic", "profit_margin": "net_profit / nullif(revenue, 0)",
    "asset_turnover": "revenue / nullif(total_assets, 0)", "leverage": "total_assets / nullif(equity, 0)", "revenue_growth": "revenue_growth", "profit_growth": "profit_growth", "roe_growth": "roe_growth",
    "market_cap": "market_cap", "log_market_cap": "CASE WHEN market_cap > 0 THEN ln(market_cap) END",
}


RANKS16 = ", ".join(f"{rank_sql(p, 'date', p in inverse)} AS r_{p}" for parts, inverse in fa.COMPOSITES.values() for p in parts)


@query(
    f"WITH v AS (SELECT fact_id, date, {', '.join(f'{s} AS {k}' for k, s in VALUES16.items())} FROM {GROWTH}), r AS (SELECT *, {RANKS16} FROM v) SELECT fact_id, {', '.join(f'round({k},6)+0.0 AS {k}' for k in VALUES16)}, "
    + ", ".join(f"round((SELECT avg(x) FROM (SELECT unnest([{', '.join('r_' + p for p in ps)}]) AS x)),6)+0.0 AS {n}_composite" for n, (ps, _) in fa.COMPOSITES.items())
    + " FROM r",
    "facts",
)
def fundamental_default_set(spark, sf):
    """All sixteen default factors; composites rank within the month."""
    f = facts(spark, sf)
    f = f.withColumns({"date": F.to_date(F.date_trunc("month", "report_period")), "roe_growth": F.col("roe") - F.lag("roe").over(Window.partitionBy("code").orderBy("report_period", "fact_id"))})
    out = f.select("fact_id", "date", *[c.alias(k) for k, c in fa.fundamental().items()])
    for name in fa.COMPOSITES:
        out = fa.composite(out, name)
    return rounded(out, "fact_id", **{k: k for k in (*VALUES16, *[f"{n}_composite" for n in fa.COMPOSITES])})


@query(
    f"""WITH v AS (SELECT code, date, close / nullif(lag(close, 5) OVER w, 0) - 1 AS momentum_5, (close - low) / nullif(high - low, 0) AS close_location FROM bars {W}),
    l AS (SELECT date, 'momentum_5' AS factor, momentum_5 AS v FROM v UNION ALL SELECT date, 'close_location', close_location FROM v),
    z AS (SELECT factor, date, CASE WHEN v IS NULL THEN NULL WHEN stddev_pop(v) OVER d > 1e-12 THEN (v - avg(v) OVER d) / stddev_pop(v) OVER d ELSE 0 END AS v FROM l WINDOW d AS (PARTITION BY factor, date))
    SELECT factor, 'ok' AS status, count(v) AS n, round(count(v) / count(*),6)+0.0 AS coverage, round(round(avg(v),9),6)+0.0 AS mean, round(stddev_samp(v),6)+0.0 AS std, round(min(v),6)+0.0 AS smallest, round(max(v),6)+0.0 AS largest, count(DISTINCT CASE WHEN v IS NOT NULL THEN date END) AS days FROM z GROUP BY factor
    UNION ALL SELECT 'no_such_column', 'failed', 0, NULL, NULL, NULL, NULL, NULL, 0""",
    "bars",
)
def factor_run_diagnostics(spark, sf):
    """Factors made, standardized and described; one that can't be made stays apart."""
    made = {"momentum_5": fa.momentum(5), "no_such_column": F.col("nothing") * 2, "close_location": fa.close_location()}
    _, told = fa.run(bars(spark, sf), made, lambda d, c: d.withColumn(c, tr.zscore(c)))
    return told.select("factor", "status", "n", *[r6(F.round(c, 9)).alias(c) for c in ("coverage", "mean", "std", "smallest", "largest")], "days")


@query(f"SELECT code, date, round(CASE WHEN row_number() OVER w > floor(count(*) OVER (PARTITION BY code) / 2) THEN close * 0.8::DOUBLE ELSE close END,6)+0.0 AS stressed FROM bars {W}", "bars")
def stress_crash(spark, sf):
    return rounded(pa.crash(bars(spark, sf)), "code", "date", stressed="stressed")


RETS = "r AS (SELECT date, code, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM bars)"
PARITY = "v AS (SELECT code, 1 / sqrt(greatest(var_samp(ret), 1e-8)) AS i FROM r GROUP BY code), c AS (SELECT code, least(i / sum(i) OVER (), 0.045::DOUBLE) AS w FROM v WHERE i IS NOT NULL), rp AS (SELECT code, w / sum(w) OVER () AS weight FROM c)"


@query(f"WITH {RETS}, {PARITY} SELECT code, round(weight,6)+0.0 AS weight FROM rp", "bars")
def risk_parity_weights(spark, sf):
    return rounded(pf.risk_parity(me.code_return(bars(spark, sf)), 0.045), "code", weight="weight")


@query(
    f"""WITH {RETS}, {PARITY}, m AS (SELECT code, sum(market_cap) / sum(sum(market_cap)) OVER () AS weight FROM bars GROUP BY code), b AS (SELECT coalesce(rp.code, m.code) AS code, 0.7::DOUBLE * coalesce(rp.weight, 0) + 0.3::DOUBLE * coalesce(m.weight, 0) AS w FROM rp FULL JOIN m ON rp.code = m.code)
    SELECT code, round(w / sum(w) OVER (),6)+0.0 AS weight FROM b""",
    "bars",
)
def blended_weights(spark, sf):
    b = bars(spark, sf)
    return rounded(pf.blended({"parity": pf.risk_parity(me.code_return(b), 0.045), "market": _market(b)}, {"parity": 0.7, "market": 0.3}), "code", weight="weight")


def _market(b):
    cap = b.groupBy("code").agg(F.sum("market_cap").alias("cap"))
    return cap.select("code", sdiv("cap", F.sum("cap").over(Window.partitionBy())).alias("weight"))  # a row a code


@query(
    f"""WITH {RETS}, m AS (SELECT code, sum(market_cap) / sum(sum(market_cap)) OVER () AS weight FROM bars GROUP BY code), v AS (SELECT code, avg(ret) AS view FROM r GROUP BY code),
    c AS (SELECT a.code AS a, b.code AS b, covar_samp(a.ret, b.ret) * 252 AS cov FROM r a JOIN r b USING (date) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.code, b.code), e AS (SELECT a AS code, 2.5::DOUBLE * sum(cov * weight) AS eq FROM c JOIN m ON m.code = c.b GROUP BY a)
    SELECT code, round(eq,6)+0.0 AS equilibrium, round(eq * 0.6::DOUBLE + view * 0.4::DOUBLE,6)+0.0 AS posterior FROM e JOIN v USING (code)""",
    "bars",
)
def posterior_returns(spark, sf):
    b = bars(spark, sf)
    r = me.code_return(b)
    views = r.groupBy("code").agg(F.avg("ret").alias("view")).withColumn("confidence", F.lit(0.4))
    return rounded(pf.posterior_returns(me.covariance(r), _market(b), views), "code", equilibrium="equilibrium", posterior="posterior")


@query()
def mean_variance_weights(spark, sf):
    return pf.mean_variance(me.code_return(bars(spark, sf)).withColumn("period", F.year("date")), most=0.3)


MEASURES = """m AS (SELECT s_suppkey AS alpha, s_acctbal / 100000 AS ic, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal / 5000 END AS icir, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal / 200000 END AS quantile_spread, (s_suppkey % 11) / 10 AS hit_rate,
    CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 150000 END AS oos_ic, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 9000 END AS oos_icir, (s_suppkey % 13) / 10 AS turnover, CAST(s_suppkey % 17 AS DOUBLE) AS complexity, (s_suppkey % 10) / 10 - 0.3::DOUBLE AS max_correlation, -((s_suppkey % 9) / 20) AS max_drawdown FROM supplier)"""


def _measures(spark, sf):
    k, v = F.col("s_suppkey"), F.col("s_acctbal").cast("double")
    return src.table(spark, sf, "supplier").select(
        k.alias("alpha"), (v / 100000).alias("ic"), F.when(k % 3 != 0, v / 5000).alias("icir"), F.when(k % 4 != 0, v / 200000).alias("quantile_spread"), ((k % 11) / 10).alias("hit_rate"), F.when(k % 5 != 0, v / 150000).alias("oos_ic"),
        F.when(k % 7 != 0, v / 9000).alias("oos_icir"), ((k % 13) / 10).alias("turnover"), (k % 17).cast("double").alias("complexity"), ((k % 10) / 10 - 0.3).alias("max_correlation"), (-((k % 9) / 20)).alias("max_drawdown"),
    )


@query(
    f"""WITH {MEASURES}, p AS (SELECT *, CASE WHEN oos_ic IS NULL AND oos_icir IS NULL THEN NULL ELSE (coalesce(tanh(oos_ic / 0.03::DOUBLE), 0) + coalesce(tanh(oos_icir), 0)) / (CASE WHEN oos_ic IS NULL THEN 0 ELSE 1 END + CASE WHEN oos_icir IS NULL THEN 0 ELSE 1 END) END AS oos,
    CASE WHEN hit_rate BETWEEN 0 AND 1 THEN 2 * hit_rate - 1 END AS hit FROM m),
    s AS (SELECT *, (0.3::DOUBLE * tanh(ic / 0.03::DOUBLE) + coalesce(0.2::DOUBLE * tanh(icir), 0) + coalesce(0.2::DOUBLE * tanh(quantile_spread / 0.03::DOUBLE), 0) + coalesce(0.1::DOUBLE * hit, 0) + coalesce(0.1::DOUBLE * oos, 0))
    / (0.3::DOUBLE + CASE WHEN icir IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN quantile_spread IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN hit IS NULL THEN 0 ELSE 0.1::DOUBLE END + CASE WHEN oos IS NULL THEN 0 ELSE 0.1::DOUBLE END) AS score,
    0.1::DOUBLE * turnover + 0.01::DOUBLE * complexity + 0.1::DOUBLE * greatest(max_correlation, 0) + 0.1::DOUBLE * abs(max_drawdown) AS penalty FROM p)
    SELECT alpha, round(score,6)+0.0 AS score, round(penalty,6)+0.0 AS penalty, round(score - penalty,6)+0.0 AS fitness FROM s"""
)
def alpha_fitness(spark, sf):
    return rounded(fi.fitness(_measures(spark, sf)), "alpha", score="score", penalty="penalty", fitness="fitness")


@query(
    f"""WITH {MEASURES}, g AS (SELECT alpha, list_filter([CASE WHEN ic < 0 THEN 'ic_failed_threshold' END, CASE WHEN icir IS NULL THEN 'missing_icir' WHEN icir < 0.1::DOUBLE THEN 'icir_failed_threshold' END, CASE WHEN turnover > 1 THEN 'turnover_failed_threshold' END,
    CASE WHEN abs(max_drawdown) > 0.3::DOUBLE THEN 'max_drawdown_failed_threshold' END, CASE WHEN oos_ic IS NULL THEN 'missing_oos_ic' WHEN oos_ic <= 0 THEN 'oos_ic_not_positive' END], lambda x: x IS NOT NULL) AS f FROM m) SELECT alpha, array_to_string(f, ',') AS failures, len(f) = 0 AS accepted FROM g"""
)
def alpha_gates(spark, sf):
    out = fi.gates(_measures(spark, sf), {"ic": 0.0, "icir": 0.1}, {"turnover": 1.0, "max_drawdown": 0.3})
    return out.select("alpha", F.array_join("failures", ",").alias("failures"), "accepted")


LEAKS = """l AS (SELECT report_period AS signal_date, available_date, announcement_date AS target_date, roe, roic, profit_growth FROM facts),
    a AS (SELECT 'known_after_signal' AS "check", sum(CASE WHEN available_date > signal_date THEN 1 ELSE 0 END) AS violations FROM l UNION ALL SELECT 'target_not_after_signal', sum(CASE WHEN target_date <= signal_date THEN 1 ELSE 0 END) FROM l
    UNION ALL SELECT 'no_signal_date', sum(CASE WHEN signal_date IS NULL THEN 1 ELSE 0 END) FROM l UNION ALL SELECT 'no_known_date', sum(CASE WHEN available_date IS NULL THEN 1 ELSE 0 END) FROM l UNION ALL SELECT 'feature_is_label', 1 UNION ALL SELECT 'feature_equals_label', 1)"""


def _leaks(spark, sf):
    f = facts(spark, sf).select(F.col("report_period").alias("signal_date"), "available_date", F.col("announcement_date").alias("target_date"), "roe", "roic", "profit_growth", F.col("profit_growth").alias("copied"))
    return va.leakage(f, features=["roe", "roic", "copied"], labels=["roic", "profit_growth"])


@query(f'WITH {LEAKS} SELECT "check", CAST(violations AS BIGINT) AS violations FROM a', "facts")
def leakage_audit(spark, sf):
    return _leaks(spark, sf)


SPLITS = """t AS (SELECT n_regionkey AS split, CASE n_nationkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS part, min(DATE '2020-01-01' + CAST(n_nationkey * 9 AS INT)) AS first_day, max(DATE '2020-01-20' + CAST(n_nationkey * 5 AS INT)) AS last_day, max(DATE '2020-01-28' + CAST(n_nationkey * 5 AS INT)) AS last_label FROM nation GROUP BY ALL),
    o AS (SELECT *, CASE part WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS place FROM t), b AS (SELECT split, first_day, last_day, lag(first_day) OVER w AS bf, lag(last_day) OVER w AS en, lag(last_label) OVER w AS lb FROM o WINDOW w AS (PARTITION BY split ORDER BY place)),
    c AS (SELECT split, sum(CASE WHEN first_day <= bf THEN 1 ELSE 0 END) AS out_of_order, sum(CASE WHEN first_day <= en THEN 1 ELSE 0 END) AS overlap, sum(CASE WHEN first_day - en <= 5 THEN 1 ELSE 0 END) AS short_gap, sum(CASE WHEN lb >= first_day THEN 1 ELSE 0 END) AS label_reaches_in, sum(CASE WHEN last_day < first_day THEN 1 ELSE 0 END) AS ends_before_it_begins FROM b GROUP BY split),
    sa AS (UNPIVOT c ON out_of_order, overlap, short_gap, label_reaches_in, ends_before_it_begins INTO NAME "check" VALUE violations)"""


def _splits(spark, sf):
    k = F.col("n_nationkey").cast("int")
    part = F.when(k % 3 == 0, "train").when(k % 3 == 1, "validation").otherwise("test")
    day = lambda d, n: F.date_add(F.lit(d).cast("date"), k * n)
    return src.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("split"), part.alias("part")).agg(F.min(day("2020-01-01", 9)).alias("first_day"), F.max(day("2020-01-20", 5)).alias("last_day"), F.max(day("2020-01-28", 5)).alias("last_label"))


@query(f'WITH {SPLITS} SELECT split, "check", CAST(violations AS BIGINT) AS violations FROM sa')
def split_audit(spark, sf):
    return va.split_audit(_splits(spark, sf), 5)


@query(
    f"""WITH {LEAKS}, {SPLITS}, u AS (SELECT "check", violations FROM a UNION ALL SELECT "check", violations FROM sa), g AS (SELECT "check", sum(violations) AS n, "check" IN ('no_known_date', 'short_gap') AS warn FROM u GROUP BY "check")
    SELECT count(*) AS checks, coalesce(string_agg(CASE WHEN n > 0 AND NOT warn THEN "check" END, ',' ORDER BY "check"), '') AS failed, coalesce(string_agg(CASE WHEN n > 0 AND warn THEN "check" END, ',' ORDER BY "check"), '') AS warned, coalesce(string_agg(CASE WHEN n > 0 AND NOT warn THEN "check" END, ','), '') = '' AS passed FROM g""",
    "facts",
)
def research_gate(spark, sf):
    return va.gate(_leaks(spark, sf), va.split_audit(_splits(spark, sf), 5), warn_only=["no_known_date", "short_gap"])


PAYLOAD = "concat_ws(',', 'x', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), '', CAST(user_id % 7 AS VARCHAR), 'n/a', CAST(event_id % 5 AS VARCHAR))"


@query(f"WITH p AS (SELECT event_id, string_split({PAYLOAD}, ',') AS f FROM events), b AS (SELECT event_id, [TRY_CAST(f[2] AS DOUBLE), TRY_CAST(f[4] AS DOUBLE), TRY_CAST(f[6] AS DOUBLE)] AS bids, [TRY_CAST(f[3] AS DOUBLE), TRY_CAST(f[5] AS DOUBLE), TRY_CAST(f[7] AS DOUBLE)] AS asks FROM p) SELECT event_id, round(coalesce((coalesce(list_sum(bids), 0) - coalesce(list_sum(asks), 0)) / nullif(coalesce(list_sum(bids), 0) + coalesce(list_sum(asks), 0), 0), 0),6)+0.0 AS pressure FROM b")
def book_payload_pressure(spark, sf):
    e, text = src.table(spark, sf, "events"), lambda c: F.col(c).cast("string")
    payload = F.concat_ws(",", F.lit("x"), text("event_id"), text("user_id"), F.lit(""), (F.col("user_id") % 7).cast("string"), F.lit("n/a"), (F.col("event_id") % 5).cast("string"))
    return e.select("event_id", r6(pf.book_pressure(pa.book_levels(payload, 1, 2, 3), pa.book_levels(payload, 2, 2, 3))).alias("pressure"))


@query(
    """WITH m AS (SELECT date, avg(fwd) / 100 AS ret FROM signals WHERE fwd IS NOT NULL GROUP BY date), e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS e FROM m), d AS (SELECT *, e / greatest(1, max(e) OVER (ORDER BY date)) - 1 AS dd FROM e),
    a AS (SELECT count(*) AS n, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS growth, stddev_samp(ret) FILTER (ret < 0) AS sd, count(*) FILTER (ret < 0) AS k, min(dd) AS mdd, sum(ret) FILTER (ret > 0) AS w, sum(ret) FILTER (ret < 0) AS l FROM d)
    SELECT n, round(growth,6)+0.0 AS growth, round(CASE WHEN k > 1 THEN growth / greatest(sd * sqrt(252), 1e-8) ELSE 0 END,6)+0.0 AS sortino, round(CASE WHEN mdd < 0 THEN growth / abs(mdd) ELSE 0 END,6)+0.0 AS calmar, round(CASE WHEN l < 0 THEN coalesce(w, 0) / abs(l) ELSE 0 END,6)+0.0 AS profit_factor FROM a""",
    "signals",
)
def risk_ratios(spark, sf):
    daily = signals(spark, sf).where("fwd IS NOT NULL").groupBy("date").agg((F.avg("fwd") / 100).alias("ret"))
    return rounded(me.risk_ratios(daily), "n", **{c: c for c in ("growth", "sortino", "calmar", "profit_factor")})
