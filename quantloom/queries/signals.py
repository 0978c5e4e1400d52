"""Signal metrics, expressions, search and walk-forward queries."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from ..functions.windows import scorr
from ..operators import metrics as op
from ..operators import panel as pn
from ..operators import validate as va
from ..plans import expr
from ..plans import search as se
from .factors import rank_sql
from .registry import bars, query, r6, rounded, signals

D = "OVER (PARTITION BY date)"
PAIRS = "p AS (SELECT date, code, signal, fwd FROM signals WHERE signal IS NOT NULL AND fwd IS NOT NULL)"
CORR = "round(covar_samp({0}, {1}) / nullif(stddev_samp({0}) * stddev_samp({1}), 0), 12)"
RANKED = f"{PAIRS}, k AS (SELECT date, {rank_sql('signal')} AS a, {rank_sql('fwd')} AS b FROM p)"
RANK_IC = f"{RANKED}, d AS (SELECT date, count(*) AS n, CASE WHEN count(*) >= 5 THEN {CORR.format('a', 'b')} END AS ic FROM k GROUP BY date)"


@query(f"WITH {PAIRS} SELECT date, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN {CORR.format('signal', 'fwd')} END,6)+0.0 AS ic FROM p GROUP BY date", "signals")
def ic_series(spark, sf):
    return rounded(op.ic(signals(spark, sf)), "date", "n", ic="ic")


@query(f"WITH {RANK_IC} SELECT date, n, round(ic,6)+0.0 AS ic FROM d", "signals")
def rank_ic_series(spark, sf):
    return rounded(op.ic(signals(spark, sf), ranks=True), "date", "n", ic="ic")


@query(
    f"""WITH {RANK_IC} SELECT round(avg(ic),6)+0.0 AS mean, round(stddev_samp(ic),6)+0.0 AS std, round(avg(ic) / nullif(stddev_samp(ic), 0),6)+0.0 AS ir, round(count(*) FILTER (ic > 0) / count(ic),6)+0.0 AS positive,
    round(count(*) FILTER (ic < 0) / count(ic),6)+0.0 AS negative, round(avg(abs(ic)),6)+0.0 AS absolute, count(ic) AS n_days FROM d""",
    "signals",
)
def ic_summary(spark, sf):
    return rounded(op.ic_summary(op.ic(signals(spark, sf), ranks=True)), "n_days", **{c: c for c in ("mean", "std", "ir", "positive", "negative", "absolute")})


def _quantiles(q: str) -> str:
    return ", ".join(f"round(avg(fwd) FILTER (q = {k}),6)+0.0 AS q{k}" for k in range(1, 6)) + f", round(avg(fwd) FILTER (q = 5) - avg(fwd) FILTER (q = 1),6)+0.0 AS high_low FROM (SELECT date, fwd, {q} AS q FROM p) GROUP BY date"


ROW = "row_number() OVER (PARTITION BY date ORDER BY signal, code)"
BY_RANK = f"CASE WHEN min(signal) {D} = max(signal) {D} THEN 1 ELSE greatest(1, least(5, CAST(ceil({ROW} / count(*) {D} * 5) AS INT))) END"
BY_CUT = f"CASE WHEN count(*) {D} > 1 THEN greatest(1, CAST(ceil(({ROW} - 1) * 5 / (count(*) {D} - 1)) AS INT)) END"
FIVE = {f"q{k}": f"q{k}" for k in range(1, 6)} | {"high_low": "high_low"}


@query(f"WITH {PAIRS} SELECT date, {_quantiles(BY_RANK)}", "signals")
def quantile_returns_a(spark, sf):
    return rounded(op.quantile_returns(signals(spark, sf)), "date", **FIVE)


@query(f"WITH {PAIRS} SELECT date, {_quantiles(BY_CUT)}", "signals")
def quantile_returns_b(spark, sf):
    return rounded(op.quantile_returns(signals(spark, sf), by_cut=True), "date", **FIVE)


@query(f"WITH {PAIRS}, t AS (SELECT *, quantile_cont(signal, 0.2) {D} AS lo, quantile_cont(signal, 0.8) {D} AS hi FROM p) SELECT date, round(CASE WHEN count(*) >= 5 THEN avg(fwd) FILTER (signal >= hi) - avg(fwd) FILTER (signal <= lo) END,6)+0.0 AS spread FROM t GROUP BY date", "signals")
def quantile_spread_threshold(spark, sf):
    return rounded(op.tail_spread(signals(spark, sf)), "date", spread="spread")


HELD = "h AS (SELECT date, list(code ORDER BY code) AS held FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal DESC, code) AS k FROM signals WHERE signal IS NOT NULL) WHERE k <= 5 GROUP BY date), l AS (SELECT date, held, lag(held) OVER (ORDER BY date) AS before FROM h)"


@query(f"WITH {HELD} SELECT date, round(1 - len(list_intersect(held, coalesce(before, []))) / len(held),6)+0.0 AS turnover FROM l", "signals")
def turnover_overlap(spark, sf):
    return rounded(op.turnover_overlap(op.top_holdings(signals(spark, sf), 5)), "date", turnover="turnover")


@query(f"WITH {HELD} SELECT date, round((len(held) + len(before) - 2 * len(list_intersect(held, before))) / (len(held) + len(before) - len(list_intersect(held, before))),6)+0.0 AS turnover FROM l", "signals")
def turnover_union(spark, sf):
    return rounded(op.turnover_union(op.top_holdings(signals(spark, sf), 5)), "date", turnover="turnover")


@query(
    f"""WITH p AS (SELECT date, code, signal FROM signals WHERE signal IS NOT NULL), q AS (SELECT date, code, {BY_RANK} AS q FROM p), w AS (SELECT date, code, 1 / count(*) OVER (PARTITION BY date) AS weight FROM q WHERE q = 5),
    d AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM w)), c AS (SELECT i, code, weight FROM w JOIN d USING (date) UNION ALL SELECT i + 1, code, -weight FROM w JOIN d USING (date)),
    m AS (SELECT i, code, abs(sum(weight)) AS v FROM c GROUP BY ALL) SELECT d.date, round(sum(v) / 2,6)+0.0 AS turnover FROM m JOIN d USING (i) WHERE i > 1 GROUP BY d.date""",
    "signals",
)
def turnover_half_l1(spark, sf):
    return rounded(op.turnover_weights(op.equal_weights(signals(spark, sf).where("signal IS NOT NULL"))), "date", turnover="turnover")


@query(f"SELECT round({CORR.format('a', 'b')},6)+0.0 AS autocorr FROM (SELECT signal AS a, lag(signal) OVER (PARTITION BY code ORDER BY date) AS b FROM signals) WHERE a IS NOT NULL AND b IS NOT NULL", "signals")
def signal_autocorr(spark, sf):
    return rounded(op.autocorrelation(signals(spark, sf)), autocorr="autocorr")


HORIZONS = (1, 3, 5, 10)


@query(
    "WITH f AS (SELECT close / nullif(lag(close, 3) OVER w, 0) - 1 AS s, " + ", ".join(f"lead(close, {h}) OVER w / nullif(close, 0) - 1 AS f{h}" for h in HORIZONS) + " FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)) SELECT "
    + ", ".join(f"round((SELECT {CORR.format('s', f'f{h}')} FROM f WHERE s IS NOT NULL AND f{h} IS NOT NULL),6)+0.0 AS corr_{h}" for h in HORIZONS),
    "bars",
)
def decay_profile(spark, sf):
    from ..functions.num import sdiv
    from ..functions.windows import lag

    b = bars(spark, sf).withColumn("s", sdiv("close", lag("close", 3)) - 1)
    return rounded(op.decay(b, "s", HORIZONS), **{f"corr_{h}": f"corr_{h}" for h in HORIZONS})


MARKET = "m AS (SELECT date, avg(fwd) AS ret FROM signals WHERE fwd IS NOT NULL GROUP BY date), e AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS equity FROM m), c AS (SELECT *, equity / greatest(1, max(equity) OVER (ORDER BY date)) - 1 AS drawdown FROM e)"


def _market(spark, sf):
    return signals(spark, sf).where("fwd IS NOT NULL").groupBy("date").agg(F.avg("fwd").alias("ret"))


@query(f"WITH {MARKET} SELECT date, round(ret,6)+0.0 AS ret, round(drawdown,6)+0.0 AS drawdown FROM c", "signals")
def drawdown_curve(spark, sf):
    return rounded(op.equity(_market(spark, sf)), "date", ret="ret", drawdown="drawdown")


@query(
    f"""WITH {MARKET} SELECT count(ret) AS n, round(avg(ret),6)+0.0 AS mean, round(stddev_samp(ret) * sqrt(252),6)+0.0 AS volatility, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252),6)+0.0 AS sharpe, round(avg(ret) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) * sqrt(252),6)+0.0 AS sortino,
    round(min(drawdown),6)+0.0 AS max_drawdown, round(count(*) FILTER (ret > 0) / count(ret),6)+0.0 AS win_rate, round(sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0),6)+0.0 AS profit_factor FROM c""",
    "signals",
)
def performance_metrics(spark, sf):
    return rounded(op.performance(_market(spark, sf)), "n", **{c: c for c in ("mean", "volatility", "sharpe", "sortino", "max_drawdown", "win_rate", "profit_factor")})


@query(f"WITH {MARKET}, o AS (SELECT ret, row_number() OVER (ORDER BY ret, date) - 1 AS i, count(*) OVER () AS n FROM m) SELECT round(ret,6)+0.0 AS value_at_risk FROM o WHERE i = floor(round(n * 0.05::DOUBLE, 9))", "signals")
def var_95(spark, sf):
    return rounded(op.value_at_risk(_market(spark, sf)), value_at_risk="value_at_risk")


# expressions
f_, c_, o_ = expr.Feature, expr.Constant, lambda name, *a: expr.Op(name, a)
SIMPLE = o_("div", o_("sub", f_("close"), f_("open")), o_("add", o_("sub", f_("high"), f_("low")), c_(0.001)))
NESTED = o_("zscore", o_("mul", o_("rank", o_("div", f_("close"), f_("open"))), o_("sign", o_("sub", o_("rank", f_("volume")), c_(0.5)))))


@query("SELECT code, date, round(CASE WHEN abs(high - low + 0.001::DOUBLE) > 1e-12 THEN (close - open) / (high - low + 0.001::DOUBLE) END,6)+0.0 AS signal FROM bars", "bars")
def alpha_expr_simple(spark, sf):
    return rounded(expr.evaluate(bars(spark, sf), {"signal": SIMPLE}), "code", "date", signal="signal")


@query(
    f"""WITH a AS (SELECT *, CASE WHEN abs(open) > 1e-12 THEN close / open END AS x FROM bars), b AS (SELECT code, date, {rank_sql('x')} * sign({rank_sql('volume')} - 0.5) AS y FROM a)
    SELECT code, date, round(CASE WHEN y IS NOT NULL THEN CASE WHEN stddev_pop(y) {D} > 1e-12 THEN (y - avg(y) {D}) / stddev_pop(y) {D} ELSE 0 END END,6)+0.0 AS signal FROM b""",
    "bars",
)
def alpha_expr_nested(spark, sf):
    return rounded(expr.evaluate(bars(spark, sf), {"signal": NESTED}), "code", "date", signal="signal")


def _panel(spark, sf):
    return bars(spark, sf).withColumn("fwd", pn.next_open_return())


BATCH = {"a": SIMPLE, "b": o_("neg", f_("volume")), "c": o_("rank", f_("amount"))}


@query(
    f"""WITH f AS (SELECT *, lead(close) OVER w / nullif(lead(open) OVER w, 0) - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)), g AS (SELECT *, {rank_sql('amount')} AS ra FROM f WHERE fwd IS NOT NULL),
    x AS (SELECT 'a' AS signal, date, fwd, (close - open) / nullif(high - low + 0.001::DOUBLE, 0) AS x FROM g UNION ALL SELECT 'b', date, fwd, -volume FROM g UNION ALL SELECT 'c', date, fwd, ra FROM g),
    k AS (SELECT signal, date, {rank_sql('x', 'signal, date')} AS a, {rank_sql('fwd', 'signal, date')} AS b FROM x WHERE x IS NOT NULL), d AS (SELECT signal, date, CASE WHEN count(*) >= 5 THEN {CORR.format('a', 'b')} END AS ic FROM k GROUP BY ALL)
    SELECT signal, round(avg(ic),6)+0.0 AS ic_mean, round(avg(ic) / nullif(stddev_samp(ic), 0),6)+0.0 AS ic_ir, round(count(*) FILTER (ic > 0) / count(ic),6)+0.0 AS positive, count(ic) AS n_days FROM d GROUP BY signal""",
    "bars",
)
def alpha_batch_metrics(spark, sf):
    return rounded(se.measure(_panel(spark, sf), BATCH), "signal", "n_days", ic_mean="ic_mean", ic_ir="ic_ir", positive="positive")


def _pair(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, round({CORR.format(a, b)},6)+0.0 AS corr FROM s"


@query(f"WITH s AS (SELECT (close - open) / nullif(high - low + 0.001::DOUBLE, 0) AS a, -volume AS b, {rank_sql('amount')} AS c FROM bars) " + " UNION ALL ".join(_pair(a, b) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))), "bars")
def alpha_signal_corr_matrix(spark, sf):
    return rounded(op.correlations(expr.evaluate(bars(spark, sf), BATCH), list(BATCH)), "a", "b", corr="corr")


def _library(spark, sf, find):
    """What find(panel, columns) comes back with, as a table; the panel is kept while it looks."""
    panel = _panel(spark, sf).cache()
    try:
        found = find(panel, ["open", "high", "low", "close", "volume", "amount"])
    finally:
        panel.unpersist()
    return spark.createDataFrame(se.library_rows(found), "fingerprint string, expression string, ic double, ir double, score double")


@query(
    f"""WITH f AS (SELECT *, lead(close) OVER w / nullif(lead(open) OVER w, 0) - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)), g AS (SELECT *, {rank_sql('amount')} AS ra FROM f WHERE fwd IS NOT NULL),
    x AS (SELECT 'a' AS signal, date, fwd, (close - open) / nullif(high - low + 0.001::DOUBLE, 0) AS x FROM g UNION ALL SELECT 'b', date, fwd, -volume FROM g UNION ALL SELECT 'c', date, fwd, ra FROM g),
    k AS (SELECT signal, date, fwd, {rank_sql('x', 'signal, date')} AS a, {rank_sql('fwd', 'signal, date')} AS b FROM x WHERE x IS NOT NULL),
    d AS (SELECT signal, date, date < DATE '1998-01-01' AS early, CASE WHEN count(*) >= 5 THEN {CORR.format('a', 'b')} END AS ic, CASE WHEN count(*) >= 5 THEN avg(fwd) FILTER (round(a * n * 2) / 2 > n * (1 - 0.2::DOUBLE)) - avg(fwd) FILTER (round(a * n * 2) / 2 <= n * 0.2::DOUBLE) END AS spread
      FROM (SELECT *, count(*) OVER (PARTITION BY signal, date) AS n FROM k) GROUP BY signal, date),
    m AS (SELECT signal, avg(ic) FILTER (early) AS ic, avg(ic) FILTER (early) / nullif(stddev_samp(ic) FILTER (early), 0) AS icir, count(*) FILTER (early AND ic > 0) / count(ic) FILTER (early) AS hit_rate, avg(spread) FILTER (early) AS quantile_spread,
      avg(ic) FILTER (NOT early) AS oos_ic, avg(ic) FILTER (NOT early) / nullif(stddev_samp(ic) FILTER (NOT early), 0) AS oos_icir, count(ic) FILTER (early) AS n_days FROM d GROUP BY signal),
    w AS (SELECT *, (0.3::DOUBLE * tanh(ic / 0.03::DOUBLE) + 0.2::DOUBLE * tanh(icir) + 0.2::DOUBLE * tanh(quantile_spread / 0.03::DOUBLE) + 0.1::DOUBLE * (2 * hit_rate - 1) + 0.1::DOUBLE * (tanh(oos_ic / 0.03::DOUBLE) + tanh(oos_icir)) / 2) / 0.9::DOUBLE - 0.01::DOUBLE * complexity AS fitness,
      concat_ws(',', CASE WHEN ic < 0 THEN 'ic_failed_threshold' END, CASE WHEN n_days < 20 THEN 'n_days_failed_threshold' END, CASE WHEN complexity > 25 THEN 'complexity_failed_threshold' END, CASE WHEN oos_ic <= 0 THEN 'oos_ic_not_positive' END) AS failures
      FROM m JOIN (VALUES {", ".join(f"('{k}', {expr.complexity(n)}::DOUBLE)" for k, n in BATCH.items())}) c(signal, complexity) USING (signal))
    SELECT signal, n_days, failures, round(ic,6)+0.0 AS ic, round(icir,6)+0.0 AS icir, round(quantile_spread,6)+0.0 AS quantile_spread, round(oos_ic,6)+0.0 AS oos_ic, round(fitness,6)+0.0 AS fitness, CASE WHEN failures = '' THEN CAST(row_number() OVER (PARTITION BY failures = '' ORDER BY fitness DESC, signal) AS INT) ELSE 0 END AS place FROM w""",
    "bars",
)
def alpha_gated_batch(spark, sf):
    """Three signals with all measures, fitness, failed gates and place."""
    found = se.graded(_panel(spark, sf), BATCH, since="1998-01-01")
    return rounded(found.withColumns({"failures": F.array_join("failures", ","), "place": F.coalesce("place", F.lit(0))}), "signal", "n_days", "failures", "place", **{c: c for c in ("ic", "icir", "quantile_spread", "oos_ic", "fitness")})


@query()
def alpha_search(spark, sf):
    """All candidates of a search with measures, fitness, failed gates and place."""
    panel, names = _panel(spark, sf), ["open", "high", "low", "close", "volume", "amount"]
    rng = random.Random(0)
    nodes = [n for n in se.distinct([expr.random_tree(rng, names) for _ in range(32)]) if expr.features(n)]
    told = spark.createDataFrame([(f"s{i}", expr.fingerprint(n), expr.to_json(n)) for i, n in enumerate(nodes)], "signal string, fingerprint string, expression string")
    return told.join(se.graded(panel, {f"s{i}": n for i, n in enumerate(nodes)}, since="1998-01-01"), "signal")


@query()
def alpha_evolution(spark, sf):
    return _library(spark, sf, lambda p, names: se.evolve(p, names, generations=3, size=12, since="1998-01-01"))


# splits and walk-forward
SPLIT = va.Split(train=100, test=40, purge=5, embargo=3)
GROWING = va.Split(train=100, test=40, purge=5, expanding=True)


def _spans(start: str, embargo: bool) -> str:
    parts = f"SELECT k, 'train' AS part, {start} AS lo, k * 40 + 99 AS hi FROM s UNION ALL SELECT k, 'purge', k * 40 + 100, k * 40 + 104 FROM s UNION ALL SELECT k, 'test', k * 40 + 105, k * 40 + 144 FROM s"
    if embargo:
        parts += " UNION ALL SELECT k, 'embargo', k * 40 + 145, least(n - 1, k * 40 + 147) FROM s WHERE k * 40 + 145 < n"
    return f"""d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)), s AS (SELECT k, n FROM (SELECT max(n) AS n FROM d), range(0, 1000) r(k) WHERE k * 40 + 145 <= n), p AS ({parts}),
    t AS (SELECT CAST(p.k AS INT) AS split, part, a.date AS first_day, b.date AS last_day, CAST(hi - lo + 1 AS INT) AS n_days FROM p JOIN d a ON a.i = p.lo JOIN d b ON b.i = p.hi)"""


@query(f"WITH {_spans('k * 40', True)} SELECT * FROM t", "bars")
def split_windows_rolling(spark, sf):
    return va.splits(pn.calendar(bars(spark, sf)), SPLIT)


@query(f"WITH {_spans('0', False)} SELECT * FROM t", "bars")
def split_windows_expanding(spark, sf):
    return va.splits(pn.calendar(bars(spark, sf)), GROWING)


@query(f"WITH {_spans('k * 40', True)} SELECT split, part, d.date FROM t JOIN d ON d.date BETWEEN first_day AND last_day", "bars")
def split_labels(spark, sf):
    days = pn.calendar(bars(spark, sf))
    return va.labelled(days, va.splits(days, SPLIT))


def _walk(spark, sf):
    return va.walk_forward_days(signals(spark, sf), SPLIT)


WALK = f"{_spans('k * 40', True)}, " + RANK_IC.replace("p AS", "pp AS").replace("FROM p)", "FROM pp)").replace("d AS (SELECT date, count", "dd AS (SELECT date, count")
WALK += ", wf AS (SELECT split, part, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS ic_ir, count(ic) AS n_days FROM t JOIN dd ON dd.date BETWEEN first_day AND last_day WHERE part IN ('train', 'test') AND ic IS NOT NULL GROUP BY split, part)"


@query(f"WITH {WALK} SELECT split, part, n_days, round(ic_mean,6)+0.0 AS ic_mean, round(ic_ir,6)+0.0 AS ic_ir FROM wf", "signals")
def walk_forward_ic(spark, sf):
    return rounded(_walk(spark, sf), "split", "part", "n_days", ic_mean="ic_mean", ic_ir="ic_ir")


@query(
    f"""WITH {WALK}, x AS (SELECT split, max(ic_mean) FILTER (part = 'train') AS train, max(ic_mean) FILTER (part = 'test') AS test FROM wf GROUP BY split)
    SELECT count(test) AS n_splits, round(avg(test),6)+0.0 AS test_mean, round(quantile_cont(test, 0.5),6)+0.0 AS test_median, round(stddev_samp(test),6)+0.0 AS test_std, round(count(*) FILTER (test > 0) / count(test),6)+0.0 AS pass_rate, round(avg(train - test),6)+0.0 AS decay FROM x""",
    "signals",
)
def walk_forward_summary(spark, sf):
    return rounded(va.walk_forward_summary(_walk(spark, sf)), "n_splits", **{c: c for c in ("test_mean", "test_median", "test_std", "pass_rate", "decay")})


@query(f"WITH {RANK_IC} SELECT round(avg(ic) FILTER (date < DATE '2000-01-01'),6)+0.0 AS ic_in, round(avg(ic) FILTER (date >= DATE '2000-01-01'),6)+0.0 AS ic_out, count(ic) FILTER (date >= DATE '2000-01-01') AS days_out FROM d", "signals")
def oos_ic(spark, sf):
    return rounded(va.out_of_sample(signals(spark, sf), "2000-01-01"), "days_out", ic_in="ic_in", ic_out="ic_out")


def _line(x: np.ndarray) -> np.ndarray:
    """Sums of rows (x, y) whose both are known: n, x, y, xx, xy."""
    a, b = x[~np.isnan(x).any(axis=1)].T
    return np.array([len(a), a.sum(), b.sum(), (a * a).sum(), (a * b).sum()])


def _slope(sums: np.ndarray) -> np.ndarray:
    n, a, b, aa, ab = sums
    slope = (n * ab - a * b) / (n * aa - a * a) if n * aa - a * a > 0 else np.nan
    return np.array([slope, (b - slope * a) / n if n else np.nan])


@query(
    f"""WITH {_spans('k * 40', True)}, x AS (SELECT t.split, t.part, s.* FROM t JOIN signals s ON s.date BETWEEN t.first_day AND t.last_day),
    m AS (SELECT split, regr_slope(fwd, signal) AS slope, regr_intercept(fwd, signal) AS icpt FROM x WHERE part = 'train' GROUP BY split)
    SELECT x.split, count(x.signal) AS n, round(avg(slope * x.signal + icpt) * 1000,6)+0.0 AS mean_prediction, round(corr(slope * x.signal + icpt, x.fwd),6)+0.0 AS corr FROM x JOIN m USING (split) WHERE part = 'test' GROUP BY x.split""",
    "signals",
)
def walk_forward_callbacks(spark, sf):
    """A line fitted to each split's train part by the user's functions, scored on its test part."""
    rows = va.with_splits(signals(spark, sf).select("code", "date", "signal", "fwd"), pn.calendar(bars(spark, sf)), SPLIT)
    found = va.walk_forward_with(rows, ["signal", "fwd"], _line, _slope, lambda x, m: m[0] * x[:, 0] + m[1])
    p = F.col("prediction")
    return found.groupBy("split").agg(F.count(p).alias("n"), r6(F.avg(p) * 1000).alias("mean_prediction"), r6(scorr(p, F.col("fwd"))).alias("corr"))
