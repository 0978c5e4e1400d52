"""Research operators against plain ones: residuals, blocked correlations, consensus, the factor lifecycle, walk-forward callbacks."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import lifecycle, metrics, text, transforms, validate
from quantloom.plans import search

DAY = datetime.date(2020, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def test_residuals_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(6):
        for c in range(12 if d else 4):
            a, b = rng.normal(size=2).tolist()
            third = {1: 2 * a - b, 2: 7.0, 3: a}.get(d, float(rng.normal()))  # explained by the others, constant, a copy
            rows.append((f"c{c}", day(d), a + 3 * b + float(rng.normal()), a, None if (d, c) == (4, 2) else b, float("nan") if (d, c) == (5, 1) else third, 1))
    rows.append(("none", None, 1.0, 1.0, 1.0, 1.0, 1))
    df = spark.createDataFrame(rows, "code string, date date, y double, a double, b double, c double, `x.y` int")
    made = transforms.orthogonalize(df, "y", ["a", "b", "c"], diagnostics=True)
    got = {(r.code, r.date): (r.residual, r.residual_r2) for r in made.collect()}
    assert made.columns == [*df.columns, "residual", "residual_r2"] and "Pandas" not in made._jdf.queryExecution().executedPlan().toString()
    for d in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == d]
        ok = [all(v is not None and math.isfinite(v) for v in r[2:6]) for r in own]
        x = np.array([[1, *r[3:6]] for r, k in zip(own, ok, strict=True) if k], float)
        y = np.array([r[2] for r, k in zip(own, ok, strict=True) if k])
        if len(y) > 4:
            e = iter(y - x @ np.linalg.lstsq(x, y, rcond=None)[0])
            want = [next(e) if k else None for k in ok]
            r2 = 1 - sum(v * v for v in want if v is not None) / ((y - y.mean()) ** 2).sum()
        else:
            want, r2 = [None] * len(own), None
        for r, w in zip(own, want, strict=True):
            assert got[r[0], d][0] == (w if w is None else pytest.approx(w, abs=1e-8))
            assert got[r[0], d][1] == (r2 if r2 is None else pytest.approx(r2, abs=1e-8))


def test_blocked_correlations_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 9)) + 1e6  # a large mean, so that raw sums would cancel
    x[:, 1] = 2 * x[:, 0] + 1e-3 * rng.normal(size=200)
    x[:, 2] = 5.0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[30:, 3], x[:180, 4] = np.nan, np.nan
    names = [f"s{i}" for i in range(9)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r.a, r.b): (r.n, r["corr"]) for r in metrics.gram_correlations(df, names, 30, block=4).collect()}
    assert len(got) == 36
    for i in range(9):
        for j in range(i + 1, 9):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            n, corr = got[f"s{i}", f"s{j}"]
            assert n == both.sum()
            if n < 30 or 2 in (i, j):
                assert corr is None
            else:
                assert corr == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)


def test_five_hundred_signals_make_a_small_plan(spark):
    df = spark.range(400).select(*[F.rand(i).alias(f"s{i}") for i in range(250)], *[F.rand(i % 250).alias(f"s{i}") for i in range(250, 500)])
    pairs = metrics.gram_correlations(df, df.columns)
    assert len(pairs._jdf.queryExecution().optimizedPlan().toString()) < 120_000
    found = [search.Candidate(n, ("col", n), 0.1, 0.1, 0.1) for n in df.columns]
    kept = search.greedy(found, pairs, 0.9)
    assert [c.name for c in kept] == [f"s{i}" for i in range(250)]  # the other half are copies


def test_pairs_with_little_overlap_are_kept(spark):
    rows = [("a", day(i), float(i), float(i), float(i) if i < 20 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "code string, date date, x double, y double, z double")
    pairs = metrics.gram_correlations(df, ["x", "y", "z"], 30)
    found = [search.Candidate(n, ("col", n), 0.1, 0.1, 0.1) for n in "xyz"]
    assert [c.name for c in search.greedy(found, pairs, 0.9)] == ["x", "z"]


def greedy_leaders(n, links):
    lead = {}
    for v in range(n):
        lead[v] = min((a for a, b in links if b == v and lead[a] == a), default=v)
    return lead


def test_leaders_equal_taking_them_in_order(spark):
    for seed in range(3):
        rng = random.Random(seed)
        links = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)} | ({(k, k + 1) for k in range(39)} if seed == 2 else set())
        nodes = spark.createDataFrame([(k,) for k in range(42)], "node int")
        got = {r.node: r.leader for r in text.leaders(nodes, spark.createDataFrame(sorted(links), "a int, b int")).collect()}
        assert got == greedy_leaders(42, links)
    assert {tuple(r) for r in text.leaders(nodes, spark.createDataFrame([], "a int, b int")).collect()} == {(k, k) for k in range(42)}


def test_consensus(spark):
    rows = [
        (1, "x", "risk", "up", ["debt", "rises", "fast"], "debt rises fast", 0.5),
        (2, "y", "risk", "up", ["fast", "debt", "rises"], "fast debt rises", 0.7),  # the same words
        (3, "z", "risk", "up", ["debt", "rises", "slowly", "now"], "debt rises slowly now", 0.9),  # 2 of 5
        (4, "y", "risk", "down", ["debt", "rises", "fast"], "debt rises fast", 0.5),  # another direction
        (5, "y", "risk", "up", ["sales", "fall"], "sales fall", 0.5),
        (6, "y", "risk", "up", ["sales", "fall"], "sales fall!", 0.5),  # one agent alone
        (7, "y", None, "up", [], "", 0.5), (8, "z", None, "up", ["a"], "a", None), (9, "y", None, "up", ["a"], "a", 0.2),
    ]
    df = spark.createDataFrame(rows, "claim_id int, agent_id string, category string, direction string, words array<string>, text string, confidence double")
    got = sorted(tuple(r) for r in text.consensus(df).collect())
    assert got == [(1, "risk", "up", "debt rises slowly now", 3, 3, pytest.approx(0.7)), (8, "", "up", "a", 2, 2, pytest.approx(0.2))]
    assert text.consensus(df.limit(0)).collect() == []


def test_consensus_meets_leaders_only(spark, monkeypatch):
    """Blocks, steps and counts of a few claims each give what taking them in order gives; no claims meet pair by pair."""
    for k, v in (("BLOCK", 7), ("STEP", 3), ("CELLS", 64)):
        monkeypatch.setattr(text, k, v)
    monkeypatch.setattr(text, "similar", lambda *a, **b: pytest.fail("all pairs of claims"))
    rng = random.Random(5)
    rows = [(k, rng.choice("xyz"), rng.choice(["risk", None]), "up", rng.sample("abcdefghij", rng.randint(0, 5)), f"t{k}", 0.5) for k in rng.sample(range(1000), 90)]
    want: dict = {}
    led: dict = {}
    for k, agent, topic, _, words, *_ in sorted(rows):
        if words:
            own = led.setdefault(topic, {})
            leader = next((n for n, w in own.items() if len(w & set(words)) / len(w | set(words)) >= 0.35), k)
            own.setdefault(leader, set(words))
            want.setdefault((leader, topic or ""), []).append((k, agent))
    got = text.consensus(spark.createDataFrame(rows, "claim_id int, agent_id string, category string, direction string, words array<string>, text string, confidence double"))
    assert {(r.leader, r.category): (r.claims, r.agents) for r in got.collect()} == {k: (len(v), len({a for _, a in v})) for k, v in want.items() if len({a for _, a in v}) > 1}


FACTS = "code string, date date, available_date date, announcement_date date, x double"


def facts(*more):
    return [(c, day(k), day(k + 3), None, float(k + (c == "b"))) for c in "ab" for k in range(5)] + [("c", day(0), None, day(1), None), *more]


def test_lifecycle_of_clean_facts(spark):
    df = spark.createDataFrame(facts(), FACTS)
    values, found = lifecycle.run(df, {"f": F.col("x") * 2}, str(day(8)), universe=spark.createDataFrame([("a",), ("c",)], "code string"), stages=lambda d, c: d.withColumn(c, F.col(c) + 1))
    assert {(r.code, r.date, r.f) for r in values.collect()} == {("a", day(k), 2.0 * k + 1) for k in range(5)} | {("c", day(0), None)}
    assert tuple(found.first())[:4] == ("f", 5, pytest.approx(5 / 6), 5.0)


@pytest.mark.parametrize(
    ("rows", "told"),
    [
        ([("late", day(2), day(9), None, 1.0)], ["not known by", "code=late", "known_date=2020-01-10"]),
        ([("unknown", day(2), None, None, 1.0)], ["not known by", "code=unknown", "known_date=null"]),
        ([("a", day(2), day(3), None, 1.0)], ["a repeated key", "code=a", "date=2020-01-03"]),
        ([(None, day(2), day(3), None, 1.0)], ["without a key", "code=null"]),
        ([("odd", day(2), day(3), None, float("inf"))], ["not finite", "code=odd"]),
    ],
)
def test_lifecycle_stops_and_names_the_row(spark, tmp_path, rows, told):
    values, _ = lifecycle.run(spark.createDataFrame(facts(*rows), FACTS), {"f": F.col("x") * 2}, str(day(8)))
    with pytest.raises(Exception) as e:
        values.write.parquet(str(tmp_path / "out"))
    assert all(t in str(e.value) for t in told)


def test_lifecycle_needs_columns_and_coverage(spark):
    with pytest.raises(ValueError, match="date"):
        lifecycle.run(spark.createDataFrame(facts(), FACTS).drop("date"), {})
    _, found = lifecycle.run(spark.createDataFrame(facts(), FACTS), {"f": F.col("x")}, str(day(8)), least_coverage=0.95)
    with pytest.raises(Exception, match="factor=f"):
        found.collect()


@pytest.mark.parametrize("s", [validate.Split(5, 3), validate.Split(5, 3, step=2, purge=1, embargo=2), validate.Split(4, 2, purge=2, expanding=True), validate.Split(5, 3, step=7), validate.Split(50, 3)])
def test_rows_of_splits(spark, s):
    days = spark.createDataFrame([(day(k), k) for k in range(23)], "date date, ordinal int")
    parts = ("train", "purge", "test", "embargo")
    got = {(r.split, r.part, r.date) for r in validate.with_splits(days.select("date"), days, s, parts).collect()}
    assert got == {(k, p, day(o)) for k, p, lo, hi in validate.split_spans(23, s) for o in range(lo, hi + 1)}


def test_walk_forward_callbacks(spark):
    rng = np.random.default_rng(6)
    rows = [(day(k), c, float(rng.normal()), float(rng.normal()) if (k, c) != (3, 1) else None) for k in range(12) for c in range(4)]
    df = spark.createDataFrame(rows, "date date, code int, x double, y double").withColumn("split", F.lit(None))
    days = spark.createDataFrame([(day(k), k) for k in range(12)], "date date, ordinal int")
    split = validate.with_splits(df.drop("split"), days, validate.Split(4, 2)).repartition(3)
    sums = lambda m: np.array([np.nansum(m[:, 1]), np.sum(~np.isnan(m[:, 1]))])
    got = validate.walk_forward_with(split, ["x", "y"], sums, lambda v: v[:1] / v[1], lambda m, v: v[0] + m[:, 0]).collect()
    assert len(got) == 4 * 2 * 4
    for r in got:
        train = [y for d, _, _, y in rows if day(2 * r.split) <= d < day(2 * r.split + 4) and y is not None]
        assert r.part == "test" and r.prediction == pytest.approx(np.mean(train) + r.x)


def test_search_grades_as_plain_code_does(spark):
    """Measures, fitness and places of several expressions against loops over dates."""
    from quantloom.plans.expr import Feature, Op

    rng = np.random.default_rng(8)
    rows = [(f"c{c}", day(k), *[float(v) for v in np.round(3 * rng.normal(size=2))], float(rng.normal()) if (k, c) != (2, 1) else None) for k in range(40) for c in range(10 if k else 4)]
    panel = spark.createDataFrame(rows, "code string, date date, u double, v double, fwd double")
    signals = {"s1": Feature("u"), "s2": Op("neg", (Feature("u"),)), "s3": Op("add", (Feature("u"), Feature("v"))), "s4": Op("rank", (Feature("v"),)), "s5": Op("mul", (Feature("u"), Feature("v")))}
    value = {"s1": lambda u, v: u, "s2": lambda u, v: -u, "s3": lambda u, v: u + v, "s4": None, "s5": lambda u, v: u * v}
    got = {r.signal: r for r in search.graded(panel, signals, since=str(day(25)), least={"ic": -0.05, "n_days": 20}, most={"complexity": 4.0}).collect()}

    def ranks(x):
        x = np.round(np.asarray(x), 12)
        return np.array([(x < a).sum() + ((x == a).sum() + 1) / 2 for a in x])

    want = {}
    for name, fn in value.items():
        ic, spread = {}, {}
        for k in range(40):
            own = [(u, v, y) for _, d, u, v, y in rows if d == day(k) and y is not None]
            x = ranks([v for _, v, _ in own]) if fn is None else [fn(u, v) for u, v, _ in own]
            a, y, n = ranks(x), np.array([y for *_, y in own]), len(own)
            if n >= 5:
                ic[k] = np.corrcoef(a, ranks(y))[0, 1]
                high, low = y[a > 0.8 * n], y[a <= n * 0.2]
                if len(high) and len(low):
                    spread[k] = high.mean() - low.mean()
        one, two = np.array([v for k, v in ic.items() if k < 25]), np.array([v for k, v in ic.items() if k >= 25])
        want[name] = (one.mean(), one.mean() / one.std(ddof=1), (one > 0).mean(), np.mean([v for k, v in spread.items() if k < 25]), two.mean(), two.mean() / two.std(ddof=1), len(one))
        r = got[name]
        assert (r.ic, r.icir, r.hit_rate, r.quantile_spread, r.oos_ic, r.oos_icir, r.n_days) == pytest.approx(want[name], abs=1e-9)
        bounded = [(0.3, np.tanh(r.ic / 0.03)), (0.2, np.tanh(r.icir)), (0.2, np.tanh(r.quantile_spread / 0.03)), (0.1, 2 * r.hit_rate - 1), (0.1, (np.tanh(r.oos_ic / 0.03) + np.tanh(r.oos_icir)) / 2)]
        assert r.fitness == pytest.approx(sum(w * v for w, v in bounded) / 0.9 - 0.01 * r.complexity)
        failed = ["ic_failed_threshold"] * (r.ic < -0.05) + ["complexity_failed_threshold"] * (r.complexity > 4) + ["oos_ic_not_positive"] * (r.oos_ic <= 0)
        assert r.failures == failed and r.accepted == (not failed)
    order = sorted((n for n in got if got[n].accepted), key=lambda n: (-got[n].fitness, n))
    assert {n: got[n].place for n in got} == {n: order.index(n) + 1 if n in order else None for n in got}
    assert any(got[n].accepted for n in got) and not all(got[n].accepted for n in got)


def test_gates_hold_inside_the_search(spark):
    rng = np.random.default_rng(9)
    rows = [(f"c{c}", day(k), float(u := rng.normal()), float(rng.normal()), float(u + rng.normal())) for k in range(45) for c in range(8)]
    panel = spark.createDataFrame(rows, "code string, date date, u double, v double, fwd double")
    found = search.search(panel, ["u", "v"], n=24, top=5, since=str(day(30)))
    assert found and all(c.ic >= 0 for c in found) and [c.score for c in found] == sorted((c.score for c in found), reverse=True)
    bred = search.evolve(panel, ["u", "v"], generations=2, size=8, since=str(day(30)))
    assert bred and bred[0].ic > 0


def test_root_crossover_and_hoist_keep_limits():
    from quantloom.plans import expr

    rng = random.Random(3)
    for _ in range(300):
        a, b = (expr.random_tree(rng, ["u", "v"], 5) for _ in range(2))
        c = expr.crossed_at_root(a, b, rng)
        if expr.depth(expr.Op("add", (a, b))) <= expr.MAX_DEPTH and expr.size(a) + expr.size(b) < expr.MAX_NODES:
            assert isinstance(c, expr.Op) and c.args == (a, b)
        m = expr.mutated(a, rng, ["u", "v"])
        assert all(x.name in expr.SCALARS or x.name in expr.DATED for x in expr.walk(m) if isinstance(x, expr.Op))


def test_wide_systems_equal_dense_ones(spark):
    """Conjugate gradients (no matrix made) and the summed matrix against numpy, for periods of several sizes at once."""
    from quantloom.operators import portfolio

    rng = np.random.default_rng(12)
    sizes = {2001: (30, 12), 2002: (6, 9), 2003: (25, 1), 2004: (1, 5)}  # dates, codes: fewer dates than codes; one code; one date
    data = {k: rng.normal(size=s) * 0.02 for k, s in sizes.items()}
    rows = [(k, day(d), f"c{c:02d}", float(v)) for k, m in data.items() for d, r in enumerate(m) for c, v in enumerate(r)]
    rows += [(2001, day(40), "c00", 0.5), (2002, day(3), "c01", None), (2005, day(1), "c01", None)]  # an incomplete date, nulls
    df = spark.createDataFrame(rows, "period int, date date, code string, ret double").repartition(4)
    df = df.where("NOT (period = 2002 AND code = 'c01' AND ret IS NULL)")
    for dense in (256, 0):
        got = {}
        for r in portfolio.minimum_variance(df, dense=dense).collect():
            got[r.period, r.code] = r.weight
        assert {k for k, _ in got} == {2001, 2002, 2003}
        for k in (2001, 2002, 2003):
            n = sizes[k][1]
            cov = np.cov(data[k].T).reshape(n, n) + 1e-6 * np.eye(n)
            w = np.linalg.solve(cov, np.ones(n))
            assert [got[k, f"c{c:02d}"] for c in range(n)] == pytest.approx((w / w.sum()).tolist(), abs=1e-6)
    assert portfolio.minimum_variance(df.where("false")).count() == 0
