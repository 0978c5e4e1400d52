"""Operators on literal rows: edges that the tables don't hold."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import num
from quantloom.operators import backtest, factors, fitness, metrics, panel, pit, portfolio, text, transforms, validate
from quantloom.plans import expr, search
from quantloom.sources import tables as src

D = dt.date


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_numbers(spark):
    df = spark.createDataFrame([(1.0, 0.0, "12.3%", "5"), (6.0, 3.0, "--", "0000123"), (None, 2.0, "1,000", None)], "a double, b double, p string, c string")
    got = rows(df.select(num.sdiv("a", "b"), num.percent("p"), num.security_code("c"), num.clip("a", 0.0, 5.0), num.safe_log("b", 0)))
    assert got[0][:4] == (None, pytest.approx(0.123), "000005", 1.0) and got[0][4] is None
    assert got[1][:4] == (2.0, None, "0000123", 5.0)
    assert got[2][:4] == (None, 1000.0, None, None)


def test_normalize_renames_defaults_and_keeps_last(spark):
    raw = spark.createDataFrame([("2024-01-02", "1", "1.0", "2", "0.5", "1.5", "10", 1), ("2024-01-02", "1", "1.0", "2", "0.5", "1.7", "10", 2), ("x", "2", "1", "1", "1", "--", "1", 3)], ["日期", "代码", "开盘", "最高", "最低", "收盘", "成交量", "n"])
    got = src.normalize(raw, "n").orderBy("code").collect()
    assert [(r.code, r.close) for r in got] == [("000001", 1.7), ("000002", None)]
    assert got[0].available_date == got[0].date == D(2024, 1, 2) and got[0].is_tradeable and not got[0].suspended
    with pytest.raises(ValueError):
        src.normalize(raw.drop("收盘"))


def test_as_of_join_takes_the_day_itself_and_nothing_later(spark):
    left = spark.createDataFrame([("a", D(2024, 3, 29)), ("a", D(2024, 3, 30)), ("b", D(2024, 3, 30))], "code string, date date")
    facts = spark.createDataFrame([("a", D(2024, 3, 30), 10.0, 1), ("a", D(2024, 4, 1), 11.0, 2), ("a", None, 12.0, 3)], "code string, available_date date, v double, fact_id long")
    assert sorted(rows(pit.as_of_join(left, facts, ["v"])), key=str) == [("a", D(2024, 3, 29), None), ("a", D(2024, 3, 30), 10.0), ("b", D(2024, 3, 30), None)]


def test_universe_bounds(spark):
    lives = spark.createDataFrame([("a", D(2020, 1, 2), D(2020, 1, 5)), ("b", None, None)], "code string, list_date date, delist_date date")
    assert rows(pit.universe(lives, "2020-01-02").select("code")) == [("a",)]
    assert not rows(pit.universe(lives, "2020-01-05")) and rows(pit.universe(lives, "2020-01-05", inclusive_delist=True).select("code")) == [("a",)]
    assert not rows(pit.universe(lives, "2020-01-01"))


def test_ranks_ties_nulls_and_constants(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 3.0), (1, "d", None), (2, "a", 5.0), (2, "b", 5.0)], "date int, code string, x double")
    got = {(r.date, r.code): (r.r, r.z, r.m) for r in df.select("date", "code", transforms.rank("x").alias("r"), transforms.zscore("x").alias("z"), transforms.minmax("x").alias("m")).collect()}
    assert got[1, "a"][0] == got[1, "b"][0] == 0.5 and got[1, "c"][0] == 1.0 and got[1, "d"] == (None, None, None)
    assert got[2, "a"] == (0.75, 0.0, 0.5)


def test_ic_of_a_monotone_and_of_a_constant_day(spark):
    df = spark.createDataFrame([(1, str(i), float(i), float(-i)) for i in range(6)] + [(2, str(i), 1.0, float(i)) for i in range(6)], "date int, code string, signal double, fwd double")
    assert sorted(rows(metrics.ic(df, ranks=True))) == [(1, 6, -1.0), (2, 6, None)]


def test_turnover_counts_codes_that_leave(spark):
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "b", 1.0), (3, "c", 1.0)], "date int, code string, weight double")
    assert sorted(rows(metrics.turnover_weights(w))) == [(2, 0.5), (3, 1.0)]


def test_calendar_previous_and_shift(spark):
    days = panel.calendar(spark.createDataFrame([(D(2024, 1, d),) for d in (1, 2, 5)], "date date"))
    ask = spark.createDataFrame([(D(2024, 1, 4),), (D(2024, 1, 5),), (D(2023, 1, 1),)], "date date")
    assert {tuple(r) for r in panel.previous_day(ask, days).collect()} == {(D(2024, 1, 4), D(2024, 1, 2)), (D(2024, 1, 5), D(2024, 1, 5)), (D(2023, 1, 1), None)}
    assert {tuple(r) for r in panel.shift_days(ask, days, -1).collect()} == {(D(2024, 1, 4), None), (D(2024, 1, 5), D(2024, 1, 2)), (D(2023, 1, 1), None)}


def test_costs_by_side(spark):
    t = spark.createDataFrame([(10.0, 100.0, "S"), (10.0, 100.0, "buy"), (0.0, 5.0, "b")], "price double, quantity double, side string")
    got = backtest.trade_costs(t).select("side", "commission", "stamp").collect()
    assert [tuple(r) for r in got] == [("sell", 5.0, 1.0), ("buy", 5.0, 0.0), ("buy", 0.0, 0.0)]


def test_rebalance_sells_first_and_keeps_lots(spark):
    prices = spark.createDataFrame([("s", D(2024, 1, d), c, 10.0) for d in (1, 2) for c in "ab"], "strategy string, date date, code string, price double")
    targets = spark.createDataFrame([("s", D(2024, 1, 1), "a", 1.0), ("s", D(2024, 1, 2), "b", 1.0)], "strategy string, date date, code string, weight double")
    got = backtest.rebalance(prices, targets, cash=10_000).orderBy("date").collect()
    assert all(r.cash >= 0 for r in got) and got[1].traded > 17_000 and got[1].equity < got[0].equity


def test_splits():
    spans = validate.split_spans(20, validate.Split(train=6, test=4, purge=1, embargo=2))
    assert spans[:4] == [(0, "train", 0, 5), (0, "purge", 6, 6), (0, "test", 7, 10), (0, "embargo", 11, 12)]
    assert max(s[3] for s in spans if s[1] == "test") <= 19 and not validate.split_spans(5, validate.Split(6, 4))


def test_expression_round_trip_and_limits():
    rng = random.Random(1)
    for _ in range(200):
        n = expr.random_tree(rng, ["a", "b"])
        assert expr.from_json(expr.to_json(n)) == n
        for m in (expr.mutated(n, rng, ["a", "b"]), expr.crossed(n, n, rng)):
            assert expr.canonical(m)
    a, b = expr.Feature("a"), expr.Feature("b")
    assert expr.fingerprint(expr.Op("add", (a, b))) == expr.fingerprint(expr.Op("add", (b, a))) != expr.fingerprint(expr.Op("sub", (a, b)))
    with pytest.raises(ValueError):
        expr.check(expr.Op("add", (a,)))
    deep = a
    for _ in range(20):
        deep = expr.Op("neg", (deep,))
    with pytest.raises(ValueError):
        expr.check(deep)


def test_batch_of_signals_shares_one_exchange_by_date(spark):
    df = spark.range(20).select((F.col("id") % 4).alias("date"), F.col("id").cast("string").alias("code"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    rank = lambda x: expr.Op("rank", (x,))
    a, b = expr.Feature("a"), expr.Feature("b")
    out = expr.evaluate(df, {"x": expr.Op("zscore", (a,)), "y": expr.Op("zscore", (expr.Op("sub", (a, b)),)), "z": expr.Op("winsorize", (b,))})
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(date") <= 1
    assert len(expr.evaluate(df, {"x": rank(rank(a))}).columns) == 5


def test_uncorrelated_drops_copies(spark):
    df = spark.range(50).select(F.lit(1).alias("date"), F.col("id").cast("string").alias("code"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    c = [search.Candidate(f"s{i}", n, 0.1, 0.1, 1.0 - i) for i, n in enumerate([expr.Feature("a"), expr.Op("neg", (expr.Feature("a"),)), expr.Feature("b")])]
    assert [x.name for x in search.uncorrelated(df, c)] == ["s0", "s2"]


def test_claims_and_sections(spark):
    df = spark.createDataFrame([(1, "a", 1, 1, ["x", "y"]), (2, "b", 1, 0, ["x", "y", "z"]), (3, "b", 1, 1, ["x"]), (4, "c", 2, 0, ["x"])], "claim_id int, agent_id string, category int, direction int, words array<string>")
    assert rows(text.conflicts(df, 0.5)) == [(1, 2, pytest.approx(2 / 3))]
    d = spark.createDataFrame([(1, "intro\n# One\nbody\n## Two\nmore\nlines"), (2, None)], "id int, t string")
    assert rows(text.sections(d, "id", "t")) == [(1, 1, "One", "body"), (1, 2, "Two", "more\nlines")]


def test_upsert_and_fingerprint(spark, tmp_path):
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string"), spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "k int, t int, v string")
    got = src.upsert(old, new, ["k"], "t")
    assert sorted(rows(got)) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    assert src.upsert(old, new, ["k"], "t", most=2).count() == 2
    src.write_table(got, str(tmp_path / "x"), partition_by=["t"])
    assert src.fingerprint(spark.read.parquet(str(tmp_path / "x")).select("k", "t", "v")).first() == src.fingerprint(got).first()


def test_aliases_of_all_names(spark):
    names = {"交易日期": "2024-01-02", "ticker": "7", "open_price": "1", "最高价": "2", "low_price": "1", "收盘价": "1.5", "成交股数": "9", "成交金额": "3", "换手": "1%", "市值": "5", "PS": "2", "ROE": "0.1", "投入资本回报率": "0.2", "公告日期": "2024-01-05", "涨停": "1", "ST": "是", "停牌": "0", "IPO日期": "2020-01-01", "所属行业": "x"}
    r = src.normalize(spark.createDataFrame([tuple(names.values())], list(names))).first()
    assert (r.code, r.close, r.volume, r.amount, r.turnover, r.market_cap, r.ps, r.roe, r.roic) == ("000007", 1.5, 9.0, 3.0, pytest.approx(0.01), 5.0, 2.0, 0.1, 0.2)
    assert (r.date, r.available_date, r.ipo_date, r.limit_up, r.is_st, r.suspended, r.industry) == (D(2024, 1, 2), D(2024, 1, 5), D(2020, 1, 1), True, True, False, "x")
    every = [a for others in src.ALIASES.values() for a in others]
    assert len(every) == len(set(every))


def test_readers(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("证券代码,x\n1,a\n000002,b\n1,c\n", encoding="utf-8")
    (tmp_path / "codes.txt").write_text("1\n\n600000\n", encoding="utf-8")
    (tmp_path / "lives.csv").write_text("代码,上市日期,退市日期\n1,2020-01-01,\n2,2021-02-03,2022-01-01\n", encoding="utf-8")
    (tmp_path / "days.csv").write_text("交易日\n2024-01-03\n2024-01-02\n2024-01-02\nnone\n", encoding="utf-8")
    (tmp_path / "bars.csv").write_text("date,code,open,high,low,close,volume\n2024-01-02,1,1,2,1,1.5,10\n2024-01-02,1,1,2,1,1.6,10\n", encoding="utf-8")
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("one\ntwo", encoding="utf-8")
    assert {r.code for r in src.read_codes(spark, f"{tmp_path}/codes.csv").collect()} == {"000001", "000002"}
    assert {r.code for r in src.read_codes(spark, f"{tmp_path}/codes.txt").collect()} == {"000001", "600000"}
    assert sorted(rows(src.read_lives(spark, f"{tmp_path}/lives.csv"))) == [("000001", D(2020, 1, 1), None, False), ("000002", D(2021, 2, 3), D(2022, 1, 1), False)]
    assert sorted(rows(src.read_calendar(spark, f"{tmp_path}/days.csv"))) == [(D(2024, 1, 2), 0), (D(2024, 1, 3), 1)]
    assert [r.close for r in src.read_panel(spark, f"{tmp_path}/bars.csv").collect()] == [1.6]
    assert [(r.path[-5:], r.text) for r in src.read_texts(spark, f"{tmp_path}/texts").collect()] == [("a.txt", "one\ntwo")]


def returns(spark, periods=2, days=40, codes=4):
    rng = np.random.default_rng(1)
    data = {(p, d): rng.normal(0.001, 0.02, codes) for p in range(periods) for d in range(days)}
    return data, spark.createDataFrame([(p, D(2024, 1, 1) + dt.timedelta(d), f"c{i}", float(x)) for (p, d), v in data.items() for i, x in enumerate(v)], "period int, date date, code string, ret double")


def test_optimizers_equal_plain_solutions(spark):
    data, df = returns(spark)
    low, mean = portfolio.minimum_variance(df).toPandas(), portfolio.mean_variance(df, most=0.5).toPandas()
    views = spark.createDataFrame([(0, "c0", 0.5)], "period int, code string, mu double")
    viewed = portfolio.mean_variance(df, views).toPandas()
    for p in range(2):
        x = np.array([data[p, d] for d in range(40)])
        cov = np.cov(x.T)
        got = low[low.period == p].sort_values("code").weight.to_numpy()
        base = got @ cov @ got
        assert got.sum() == pytest.approx(1)
        for i in range(4):  # no shift of weight between two codes lowers the variance
            for j in range(4):
                w = got.copy()
                w[i] += 1e-3
                w[j] -= 1e-3
                assert w @ cov @ w >= base - 1e-9
        raw = np.maximum(np.linalg.solve(cov + 1e-8 * np.eye(4), x.mean(axis=0)), 0)
        want = np.minimum(raw / raw.sum(), 0.5)
        assert mean[mean.period == p].sort_values("code").weight.to_numpy() == pytest.approx(want / want.sum())
    assert viewed[(viewed.period == 0) & (viewed.code == "c0")].weight.iloc[0] > 0.6


def test_stress_and_tournament(spark):
    p = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(i), 10.0) for i in range(2000)], "code string, date date, close double")
    assert [r.stressed for r in panel.crash(p.limit(3).orderBy("date"), -0.3).orderBy("date").collect()] == [10.0, 7.0, 7.0]
    shaken = [r.stressed for r in panel.shaken(p, 0.01).orderBy("date").collect()]
    steps = np.diff(np.log([10.0, *shaken]))
    assert steps.std() == pytest.approx(0.01, rel=0.1) and abs(steps.mean()) < 0.001
    assert shaken == [r.stressed for r in panel.shaken(p.repartition(5), 0.01).orderBy("date").collect()]
    m = spark.createDataFrame([(f"a{i}", float(i)) for i in range(20)] + [("none", None)], "alpha string, fitness double")
    won = fitness.tournament(m, 200, 3).toPandas()
    assert len(won) == 200 and won.fitness.mean() > 13 and won.alpha.nunique() > 5
    assert set(fitness.tournament(m, 5, 20).toPandas().alpha) == {"a19"}
    none = fitness.fitness(spark.createDataFrame([("a", None)], "alpha string, ic double")).first()
    assert none.score is None and none.fitness is None and none.penalty == 0.0


def test_factor_runs_keep_failures_apart(spark):
    p = spark.createDataFrame([("a", D(2024, 1, 1), 1.0), ("b", D(2024, 1, 1), 3.0)], "code string, date date, close double")
    values, told = factors.run(p, {"twice": F.col("close") * 2, "lost": F.col("nothing"), "text": F.col("code")})
    assert values.columns == ["code", "date", "twice"] and {r.factor: (r.status, r.n) for r in told.collect()} == {"twice": ("ok", 2), "lost": ("failed", 0), "text": ("failed", 0)}
    assert factors.run(p, {"lost": F.col("nothing")})[1].first().status == "failed"


def test_search_and_evolution_measure_what_they_return(spark):
    """Every signal that comes back has the rank correlation that its expression gives when it is measured alone."""
    rng = random.Random(1)
    p = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(d), f"{c:06d}", rng.random(), rng.random(), rng.random()) for d in range(12) for c in range(12)], "date date, code string, x double, y double, fwd double").cache()
    for found in (search.search(p, ["x", "y"], n=12, top=4), search.evolve(p, ["x", "y"], generations=2, size=6, tournament=3)):
        scores = [f.score for f in found]
        assert found and scores == sorted(scores, reverse=True) and len({expr.canonical(f.node) for f in found}) == len(found)
        for f in found:
            alone = search.measure(p, {"s": f.node}).first()
            assert alone.ic_mean == pytest.approx(f.ic)


def test_rounding_and_boards(spark):
    df = spark.createDataFrame([("300001", True, 0.125), ("600001", True, 0.375), ("600002", None, 2.5)], "code string, is_st boolean, x double")
    assert rows(df.select(panel.limit_rate(st="is_st"), num.half_even("x"))) == [(0.2, 0.12), (0.05, 0.38), (0.1, 2.5)]
