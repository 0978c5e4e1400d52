"""Technical, fundamental and cross-sectional factor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rank_pct
from ..operators import factors as op
from ..operators import lifecycle
from ..operators import transforms as tr
from .registry import bars, facts, query, rounded

W = "WINDOW w AS (PARTITION BY code ORDER BY date)"


def _roll(fn: str, x: str, n: int) -> str:
    """A rolling aggregate in SQL, null before n known values."""
    over = f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {n} THEN {fn}({x}) {over} END"


def _one(name: str, column, sql: str, prepare=None, source: str = "bars"):
    """Registers a factor of one column over the bars."""

    def run(spark, sf):
        df = bars(spark, sf)
        return rounded(prepare(df) if prepare else df, "code", "date", **{name.rsplit("_", 1)[0] if name[-1].isdigit() else name: column()})

    out = name.rsplit("_", 1)[0] if name[-1].isdigit() else name
    query(f"SELECT code, date, round({sql},6)+0.0 AS {out} FROM {source} {W}", "bars", name=name)(run)


RET = f"(SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM bars {W})"
TR = f"(SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W})"
PVT = f"(SELECT *, sum(coalesce(volume * ret, 0)) OVER (PARTITION BY code ORDER BY date) AS pvt FROM {RET})"

_one("momentum_20", lambda: op.momentum(20), "close / nullif(lag(close, 20) OVER w, 0) - 1")
_one("reversal_5", lambda: op.reversal(5), "-(close / nullif(lag(close, 5) OVER w, 0) - 1)")
_one("volatility_20", lambda: op.volatility(20, True), f"{_roll('stddev_samp', 'ret', 20)} * sqrt(252)", op.with_day_return, RET)
_one("atr_14", lambda: op.average_true_range(14), _roll("avg", "tr", 14), op.with_true_range, TR)
_one("ma_deviation_20", lambda: op.mean_deviation(20), f"close / nullif({_roll('avg', 'close', 20)}, 0) - 1")
_one("volume_ratio_20", lambda: op.ratio_to_mean("volume", 20), f"volume / nullif({_roll('avg', 'volume', 20)}, 0)")
_one("amount_ratio_20", lambda: op.ratio_to_mean("amount", 20), f"amount / nullif({_roll('avg', 'amount', 20)}, 0)")
_one("turnover_mean_20", lambda: op.roll_mean("volume", 20), _roll("avg", "volume", 20))
_one("breakout_20", lambda: op.breakout(20), f"close / nullif({_roll('max', 'high', 20)}, 0) - 1")
_one("drawdown_20", lambda: op.drawdown(20), f"close / nullif({_roll('max', 'close', 20)}, 0) - 1")
_one("high_low_range", op.high_low_range, "(high - low) / nullif(close, 0)")
_one("close_location", op.close_location, "(close - low) / nullif(high - low, 0)")
_one("pvt_20", lambda: op.volume_trend(20), "pvt - lag(pvt, 20) OVER w", lambda d: op.with_volume_trend(op.with_day_return(d)), PVT)


@query(
    f"""WITH p AS (SELECT code, date, close - lag(close) OVER w AS d, row_number() OVER w AS i FROM bars {W}),
    s AS (SELECT code, date, i, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM p WHERE i = 2 UNION ALL SELECT p.code, p.date, p.i, s.up * 13 / 14 + greatest(p.d, 0) / 14, s.down * 13 / 14 + greatest(-p.d, 0) / 14 FROM s JOIN p ON p.code = s.code AND p.i = s.i + 1)
    SELECT p.code, p.date, round(CASE WHEN p.i > 14 THEN CASE WHEN s.down = 0 AND s.up > 0 THEN 100 WHEN s.down = 0 THEN 50 ELSE 100 - 100 / (1 + s.up / nullif(s.down, 0)) END END,6)+0.0 AS rsi FROM p LEFT JOIN s ON s.code = p.code AND s.i = p.i""".replace("WITH p", "WITH p"),
    "bars",
    recursive=True,
)
def rsi_14(spark, sf):
    return rounded(op.rsi(bars(spark, sf), 14), "code", "date", rsi="rsi")


@query(f"SELECT code, date, round(close / nullif(lag(close, 20) OVER w, 0) - 1,6)+0.0 AS momentum, round(-(close / nullif(lag(close, 5) OVER w, 0) - 1),6)+0.0 AS reversal, round((high - low) / nullif(close, 0),6)+0.0 AS high_low_range, round(close / nullif({_roll('max', 'high', 20)}, 0) - 1,6)+0.0 AS breakout, round(amount / nullif({_roll('avg', 'amount', 20)}, 0),6)+0.0 AS amount_ratio FROM bars {W}", "bars")
def technical_factors(spark, sf):
    return rounded(op.technical(bars(spark, sf)), "code", "date", **{c: c for c in ("momentum", "reversal", "high_low_range", "breakout", "amount_ratio")})


FUNDAMENTAL = "1 / nullif(pe, 0) AS earnings_yield, 1 / nullif(pb, 0) AS book_to_market, 1 / nullif(ps, 0) AS sales_yield, net_profit / nullif(revenue, 0) AS profit_margin, revenue / nullif(total_assets, 0) AS asset_turnover, total_assets / nullif(equity, 0) AS leverage, CASE WHEN market_cap > 0 THEN ln(market_cap) END AS log_market_cap"
NAMES = ("earnings_yield", "book_to_market", "sales_yield", "profit_margin", "asset_turnover", "leverage", "log_market_cap")


@query(f"SELECT fact_id, {', '.join(f'round({n},6)+0.0 AS {n}' for n in NAMES)} FROM (SELECT fact_id, {FUNDAMENTAL} FROM facts)", "facts")
def fundamental_factors(spark, sf):
    made = op.fundamental()
    return rounded(facts(spark, sf), "fact_id", **{n: made[n] for n in NAMES})


def rank_sql(x: str, by: str = "date", inverse: bool = False) -> str:
    """Average rank by count among known values."""
    o = f"-({x})" if inverse else x
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {o}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2) / count({x}) OVER (PARTITION BY {by}) END"


def _composite(name: str):
    parts, inverse = op.COMPOSITES[name]

    def run(spark, sf):
        made = op.fundamental()
        f = facts(spark, sf).select("fact_id", F.trunc("report_period", "month").alias("date"), F.col("code"), *[made[p].alias(p) for p in parts])
        return rounded(op.composite(f, name), "fact_id", value=f"{name}_composite")

    ranks = ", ".join(f"{rank_sql(p, inverse=p in inverse)} AS r{i}" for i, p in enumerate(parts))
    n, total = " + ".join(f"CAST(r{i} IS NOT NULL AS INT)" for i in range(len(parts))), " + ".join(f"coalesce(r{i}, 0)" for i in range(len(parts)))
    base = f"SELECT fact_id, CAST(date_trunc('month', report_period) AS DATE) AS date, roe, roic, revenue_growth, profit_growth, {FUNDAMENTAL} FROM facts"
    query(f"SELECT fact_id, round(({total}) / nullif({n}, 0),6)+0.0 AS value FROM (SELECT fact_id, {ranks} FROM ({base}))", "facts", name=f"{name}_composite")(run)


for _name in op.COMPOSITES:
    _composite(_name)

# cross-sectional transforms of the signal
S = "SELECT code, date, {} FROM signals"


@query(f"SELECT code, date, round({rank_sql('signal')},6)+0.0 AS r, round(({rank_sql('signal')} - 0.5) * 2,6)+0.0 AS normal FROM signals", "signals")
def rank_pct_by_date(spark, sf):
    from .registry import signals

    return rounded(signals(spark, sf), "code", "date", r=rank_pct("signal"), normal=tr.rank_normalize("signal"))


def _transform(name: str, sql: str, make):
    def run(spark, sf):
        from .registry import signals

        return make(signals(spark, sf))

    query(sql, "signals", name=name)(run)


D = "OVER (PARTITION BY date)"
_transform("zscore", f"SELECT code, date, round(CASE WHEN signal IS NOT NULL THEN CASE WHEN stddev_pop(signal) {D} > 1e-12 THEN (signal - avg(signal) {D}) / stddev_pop(signal) {D} ELSE 0 END END,6)+0.0 AS z FROM signals", lambda d: rounded(d, "code", "date", z=tr.zscore("signal")))
_transform("minmax", f"SELECT code, date, round(CASE WHEN signal IS NOT NULL THEN coalesce((signal - min(signal) {D}) / nullif(max(signal) {D} - min(signal) {D}, 0), 0.5) END,6)+0.0 AS m FROM signals", lambda d: rounded(d, "code", "date", m=tr.minmax("signal")))
_transform(
    "robust_zscore",
    f"WITH m AS (SELECT *, signal - quantile_cont(signal, 0.5) {D} AS dev FROM signals) SELECT code, date, round(CASE WHEN dev IS NOT NULL THEN coalesce(dev / nullif(quantile_cont(abs(dev), 0.5) {D} * 1.4826::DOUBLE, 0), 0) END,6)+0.0 AS z FROM m",
    lambda d: rounded(tr.with_robust_zscore(d, "signal", "z"), "code", "date", z="z"),
)
_transform(
    "winsorize_mad",
    f"WITH m AS (SELECT *, quantile_cont(signal, 0.5) {D} AS mid FROM signals), v AS (SELECT *, quantile_cont(abs(signal - mid), 0.5) {D} * 1.4826::DOUBLE * 3 AS reach FROM m) SELECT code, date, round(CASE WHEN signal IS NOT NULL THEN greatest(mid - reach, least(mid + reach, signal)) END,6)+0.0 AS w FROM v",
    lambda d: rounded(tr.with_winsorized_mad(d, "signal", 3.0, "w"), "code", "date", w="w"),
)
_transform(
    "winsorize_quantile",
    f"SELECT code, date, round(CASE WHEN signal IS NOT NULL THEN greatest(quantile_cont(signal, 0.05) {D}, least(quantile_cont(signal, 0.95) {D}, signal)) END,6)+0.0 AS w FROM signals",
    lambda d: rounded(d, "code", "date", w=tr.winsorize_quantile("signal", 0.05)),
)
_transform("fill_median", f"SELECT code, date, round(coalesce(signal, quantile_cont(signal, 0.5) {D}),6)+0.0 AS filled, round(coalesce(signal, avg(signal) {D}),6)+0.0 AS by_mean FROM signals", lambda d: rounded(d, "code", "date", filled=tr.fill("signal"), by_mean=tr.fill("signal", "mean")))
_transform("cross_section_summary", "SELECT date, count(signal) AS n, CAST(sum(CASE WHEN signal IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, round(avg(signal),6)+0.0 AS mean, round(stddev_samp(signal),6)+0.0 AS std, round(min(signal),6)+0.0 AS lowest, round(max(signal),6)+0.0 AS highest FROM signals GROUP BY date", lambda d: rounded(tr.summary(d, "signal"), "date", "n", "missing", mean="mean", std="std", lowest="lowest", highest="highest"))
_transform("group_demean", "SELECT code, date, round(signal - avg(signal) OVER (PARTITION BY date, industry),6)+0.0 AS d FROM signals", lambda d: rounded(d, "code", "date", d=tr.neutralize_group("signal")))
_transform(
    "neutralize_industry_size",
    f"""WITH k AS (SELECT code, date, industry, CASE WHEN market_cap > 0 AND signal IS NOT NULL THEN signal END AS y, CASE WHEN market_cap > 0 AND signal IS NOT NULL THEN ln(market_cap) END AS s FROM signals),
    g AS (SELECT code, date, y - avg(y) OVER (PARTITION BY date, industry) AS y, s - avg(s) OVER (PARTITION BY date, industry) AS s FROM k)
    SELECT code, date, round(CASE WHEN count(y) {D} >= 3 THEN y - coalesce(CASE WHEN abs(sum(s * s) {D}) > 1e-12 THEN sum(y * s) {D} / sum(s * s) {D} END, 0) * s END,6)+0.0 AS residual FROM g""",
    lambda d: rounded(tr.neutralize_size(d, "signal"), "code", "date", residual="residual"),
)
_transform(
    "transform_pipeline",
    f"""WITH f AS (SELECT code, date, coalesce(signal, quantile_cont(signal, 0.5) {D}) AS x FROM signals), m AS (SELECT *, quantile_cont(x, 0.5) {D} AS mid FROM f), v AS (SELECT *, quantile_cont(abs(x - mid), 0.5) {D} * 1.4826::DOUBLE * 3 AS reach FROM m),
    c AS (SELECT code, date, CASE WHEN x IS NOT NULL THEN greatest(mid - reach, least(mid + reach, x)) END AS x FROM v)
    SELECT code, date, round(CASE WHEN x IS NOT NULL THEN CASE WHEN stddev_pop(x) {D} > 1e-12 THEN (x - avg(x) {D}) / stddev_pop(x) {D} ELSE 0 END END,6)+0.0 AS x FROM c""",
    lambda d: rounded(tr.pipeline(d, "signal", "x"), "code", "date", x="x"),
)


def orthogonalized(spark, sf):
    from .registry import signals

    d = signals(spark, sf).select("code", "date", "signal", F.col("market_cap").alias("a"), F.log("market_cap").alias("b"))
    return rounded(tr.orthogonalize(d, "signal", ["b"]), "code", "date", residual="residual")


query(
    """WITH k AS (SELECT code, date, signal, ln(market_cap) AS b FROM signals WHERE signal IS NOT NULL), g AS (SELECT *, regr_slope(signal, b) OVER (PARTITION BY date) AS s, regr_intercept(signal, b) OVER (PARTITION BY date) AS i, count(*) OVER (PARTITION BY date) AS n FROM k)
    SELECT x.code, x.date, round(CASE WHEN g.n > 2 THEN g.signal - g.i - g.s * g.b END,6)+0.0 AS residual FROM signals x LEFT JOIN g USING (code, date)""",
    "signals",
    name="orthogonalized",
)(orthogonalized)


@query(
    """WITH k AS (SELECT code, date, signal AS y, ln(market_cap) AS a, CAST(regexp_extract(code, '(\\d+)$', 1) AS DOUBLE) AS b FROM signals WHERE signal IS NOT NULL AND market_cap > 0),
    m AS (SELECT *, y - avg(y) OVER w AS yy, a - avg(a) OVER w AS aa, b - avg(b) OVER w AS bb, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY date)),
    g AS (SELECT *, sum(aa * aa) OVER w AS saa, sum(aa * bb) OVER w AS sab, sum(bb * bb) OVER w AS sbb, sum(aa * yy) OVER w AS say, sum(bb * yy) OVER w AS sby, sum(yy * yy) OVER w AS syy FROM m WINDOW w AS (PARTITION BY date)),
    r AS (SELECT code, date, n, yy - (say * sbb - sby * sab) / (saa * sbb - sab * sab) * aa - (sby * saa - say * sab) / (saa * sbb - sab * sab) * bb AS e, syy FROM g WHERE n > 3)
    SELECT x.code, x.date, round(e,6)+0.0 AS residual, round(1 - sum(e * e) OVER (PARTITION BY x.date) / nullif(any_value(syy) OVER (PARTITION BY x.date), 0),6)+0.0 AS r2 FROM signals x LEFT JOIN r USING (code, date)""",
    "signals",
)
def orthogonalized_two_controls(spark, sf):
    """Residual of the signal on log size and the code's number, with the share that they explain; dates where only some codes have a signal count these."""
    from .registry import signals

    d = signals(spark, sf).select("code", "date", "signal", F.log("market_cap").alias("a"), F.regexp_extract("code", r"(\d+)$", 1).cast("double").alias("b"))
    return rounded(tr.orthogonalize(d, "signal", ["a", "b"], diagnostics=True), "code", "date", residual="residual", r2="residual_r2")


@query(
    """WITH f AS (SELECT code, report_period AS date, arg_max(pe, fact_id) AS pe, arg_max(roe, fact_id) AS roe FROM facts WHERE coalesce(available_date, announcement_date) <= DATE '1998-12-31' GROUP BY code, report_period),
    v AS (SELECT code, date, 1 / nullif(pe, 0) AS earnings_yield, roe FROM f), z AS (SELECT CASE WHEN stddev_pop(earnings_yield) OVER w > 1e-12 THEN (earnings_yield - avg(earnings_yield) OVER w) / stddev_pop(earnings_yield) OVER w WHEN earnings_yield IS NOT NULL THEN 0 END AS earnings_yield,
      CASE WHEN stddev_pop(roe) OVER w > 1e-12 THEN (roe - avg(roe) OVER w) / stddev_pop(roe) OVER w WHEN roe IS NOT NULL THEN 0 END AS roe FROM v WINDOW w AS (PARTITION BY date))
    SELECT * FROM (SELECT 'earnings_yield' AS factor, count(earnings_yield) AS n, round(count(earnings_yield) / count(*),6)+0.0 AS coverage, round(avg(earnings_yield),6)+0.0 AS mean, round(stddev_samp(earnings_yield),6)+0.0 AS std, round(min(earnings_yield),6)+0.0 AS smallest, round(max(earnings_yield),6)+0.0 AS largest FROM z
      UNION ALL SELECT 'roe', count(roe), round(count(roe) / count(*),6)+0.0, round(avg(roe),6)+0.0, round(stddev_samp(roe),6)+0.0, round(min(roe),6)+0.0, round(max(roe),6)+0.0 FROM z)""",
    "facts",
)
def factor_lifecycle(spark, sf):
    """Diagnostics of two factors from facts known by the end of 1998, the last fact of each code and period; checks stand in the plan."""
    f = facts(spark, sf).withColumn("date", F.col("report_period")).where("coalesce(available_date, announcement_date) <= DATE '1998-12-31'")
    known = ["available_date", "announcement_date", "report_period", "pe", "roe"]
    one = f.groupBy("code", "date").agg(F.max_by(F.struct(*known), "fact_id").alias("r")).select("code", "date", "r.*")
    made = {"earnings_yield": op.fundamental()["earnings_yield"], "roe": F.col("roe").cast("double")}
    _, found = lifecycle.run(one, {f"{k}_z": c for k, c in made.items()}, "1998-12-31", stages=lambda d, c: d.withColumn(c, tr.zscore(c)))
    return rounded(found.withColumn("factor", F.regexp_replace("factor", "_z$", "")), "factor", "n", coverage="coverage", mean="mean", std="std", smallest="smallest", largest="largest")
