"""Exact distributed operators against plain ones: nearest vectors, as-of joins of hot keys, smoothing, order statistics."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import factors, metrics, pit, vectors

DAY = datetime.date(2020, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def brute(rows, queries, k):
    """(query, key, likeness) of the k most alike, ties by key."""
    out = set()
    m = np.array([v for _, v in rows], float)
    size = np.linalg.norm(m, axis=1)
    for i, q in queries:
        q = np.array(q, float)
        n = size * np.linalg.norm(q)
        s = np.round(np.where(n > 0, m @ q / np.where(n > 0, n, 1), 0), 12) + 0.0
        out |= {(i, rows[j][0], s[j]) for j in sorted(range(len(rows)), key=lambda j: (-s[j], rows[j][0]))[:k]}
    return out


@pytest.mark.parametrize("block", [8000, 40])
def test_nearest_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 8))
    rows = [(i, (centers[i % 12] + 0.05 * rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [(2000, [0.0] * 8), (2001, [0.0] * 8)]  # many copies; zero vectors
    df = spark.createDataFrame([*rows, (3000, None)], "vec_id long, embedding array<double>")
    queries = [rows[i] for i in range(0, len(rows), 50)] + [(-3, [0.0] * 8), (-1, centers[3].tolist())]
    index = vectors.build_index(df, sample=300, lists=20)
    got = vectors.nearest_in(index, spark.createDataFrame([*queries, (-2, None)], "vec_id long, embedding array<double>"), 5, block=block)
    found = {(r.query, r.vec_id, r.likeness + 0.0) for r in got.collect()}
    assert {(a, b) for a, b, _ in found} == {(a, b) for a, b, _ in brute(rows, queries, 5)}  # a recall of 1
    assert found == brute(rows, queries, 5)


def test_lists_are_skipped(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(16, 32))
    rows = np.concatenate([c + 0.02 * rng.normal(size=(40, 32)) for c in centers])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    index = vectors.build_index(df)
    _, seen = vectors.visits(index, vectors.unit(rows[::10], True), 5)
    assert seen.mean() < 0.35 and index.n.sum() == len(rows)


def test_nearest_vectors_of_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert vectors.nearest_of_each(df.where("false"), df).collect() == []
    assert vectors.nearest_of_each(df, df.where("false")).collect() == []
    assert sorted((r.query, r.vec_id) for r in vectors.nearest_of_each(df, df, 5).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]  # fewer than k


def test_queries_take_one_scan_of_the_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = vectors.build_index(v)
    plan = vectors.nearest_in(index, v.where("vec_id % 100 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # the lists, and the queries with where they go


def asof(rows, facts):
    """Rows (key, date, id) with the value of the last fact (key, date, tie, value) known then."""
    out = []
    for key, d, i in rows:
        known = [(f[1], f[2], f[3]) for f in facts if f[0] == key and f[1] is not None and f[1] <= d]
        out.append((key, d, i, max(known)[2] if known else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 7, 16])
def test_asof_join_of_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice("aab"), day(rng.randrange(90)), i) for i in range(300)] + [("none", day(3), 999), (None, day(5), 1000)]
    facts = [(rng.choice("abc"), day(rng.randrange(5, 80)) if rng.random() < 0.9 else None, t, float(t) if t % 7 else None) for t in range(25)]
    left = spark.createDataFrame(rows, "code string, date date, id int")
    right = spark.createDataFrame(facts, "code string, available_date date, fact_id int, v double")
    got = pit.as_of_join(left, right, ["v"], ranges=ranges).select("code", "date", "id", "v").collect()
    assert sorted(map(tuple, got), key=str) == asof(rows, facts)
    assert pit.as_of_join(left.where("false"), right, ["v"]).count() == 0
    assert pit.as_of_join(left, right.where("false"), ["v"]).where("v IS NULL").count() == len(rows)


def test_hot_key_of_asof_join_is_split(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("code"), F.date_add(F.lit(DAY), (F.col("id") / 8).cast("int")).alias("date"), "id")
    facts = spark.range(600).select(F.lit("hot").alias("code"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("available_date"), F.col("id").alias("fact_id"), (F.col("id") * 1.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        made = pit.as_of_join(left, facts, ["v"])
        sizes = [r.n for r in made.where("code = 'hot'").withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("v")).collect()]
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 3000 and len(sizes) >= 8 and max(sizes) <= 900  # at most a few of 16 ranges meet in a task
    assert plan.count("hashpartitioning(code") <= 4 and "NestedLoop" not in plan


def test_snapshots_have_no_join_of_ranges(spark):
    rng = random.Random(2)
    facts = [(rng.choice("aaab"), day(rng.randrange(60)) if rng.random() < 0.9 else None, t, float(t)) for t in range(40)]
    dates = [day(k) for k in range(0, 50, 3)]
    f = spark.createDataFrame(facts, "code string, available_date date, fact_id int, v double")
    made = pit.snapshots(spark.createDataFrame([(d,) for d in dates * 2], "date date"), f, ["v"])
    want = [r for r in asof([(k, d, 0) for k in "ab" for d in dates], facts) if r[3] is not None]
    assert sorted(map(tuple, made.select("code", "date", F.lit(0), "v").collect()), key=str) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert ">= date" not in plan.replace("#", "") and "CartesianProduct" not in plan


@pytest.mark.parametrize("n", [2, 14])
def test_rsi_equals_the_recurrence(spark, n):
    rng = random.Random(n)
    rows = []
    for code in "abc":
        price = 100.0
        for k in range({"a": 900, "b": 40, "c": 5}[code]):
            price *= 1 + rng.choice([-0.02, 0, 0.01, 0.03])
            rows.append((code, day(k), price))
    rows += [("flat", day(k), 5.0) for k in range(30)] + [("up", day(k), 5.0 + k) for k in range(30)] + [("gap", day(k), None if k in (3, 20) else 5.0 + k % 3) for k in range(40)] + [("null", day(1), None)]
    got = {(r.code, r.date): r.rsi for r in factors.rsi(spark.createDataFrame(rows, "code string, date date, close double"), n).collect()}
    assert len(got) == len(rows)
    for code in {r[0] for r in rows}:
        up = down = before = None
        seen = 0
        for _, d, close in [r for r in rows if r[0] == code]:
            step = None if close is None or before is None else close - before
            if step is not None:
                seen += 1
                gain, loss = max(step, 0), max(-step, 0)
                up, down = (gain, loss) if up is None else (up + (gain - up) / n, down + (loss - down) / n)
            before = close
            want = None if close is None or seen < n else 100.0 if down == 0 and up > 0 else 50.0 if down == 0 else 100 - 100 / (1 + up / down)
            assert got[code, d] == (want if want is None else pytest.approx(want, abs=1e-9)), (code, d)


def test_smoothing_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=5000)
    df = spark.createDataFrame([("a", day(i), float(v)) for i, v in enumerate(x)], "code string, date date, x double")
    for alpha in (0.9, 0.3, 0.01):  # 0.9: blocks of 238 rows
        got = factors.smoothed(df, alpha, y="x").orderBy("date").toPandas()["y"].to_numpy()
        assert np.allclose(got, pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), rtol=1e-9, atol=1e-12)


def test_default_set_has_no_python(spark):
    panel = spark.createDataFrame([("a", day(k), 1.0, 2.0, 0.5, 1.5, 10.0, 20.0, 0.1) for k in range(5)], "code string, date date, open double, high double, low double, close double, volume double, amount double, turnover double")
    plan = factors.default_set(panel)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_order_statistic(spark, most):
    rng = random.Random(most)
    for values in ([rng.gauss(0, 1) for _ in range(500)], [float(rng.randrange(4)) for _ in range(300)], [7.0] * 50, [1e300, -1e300, 0.0, 1e-300, -1e-300], [float(10**k) for k in range(60)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        for k in {0, 1, len(values) // 2, len(values) - 1}:
            assert metrics.order_statistic(df, "x", k, probes=5, most=most) == sorted(values)[k]
        assert metrics.order_statistic(df, "x", len(values)) is None
    assert metrics.value_at_risk(spark.createDataFrame([(None,)], "ret double")).count() == 0


def test_scratch_tables_go_and_others_stay(spark, tmp_path):
    from quantloom.sources.scratch import bucketed, dropped, written

    own = str(tmp_path / ("0123456789abcdef" * 2))  # a user's table that has a name like a scratch table's
    spark.range(5).write.parquet(own)
    a, b = written(spark.range(10)), bucketed(spark.range(20).withColumn("k", F.col("id") % 3), "id", 4)
    files = [*a.inputFiles(), *b.inputFiles()]
    assert a.count() == 10 and b.count() == 20 and files
    dropped(a, b, spark.read.parquet(own))
    import os

    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)
    assert spark.read.parquet(own).count() == 5 and not [t.name for t in spark.catalog.listTables() if t.name.startswith("scratch_")]


def test_bucketed_tables_leave_no_name_and_keep_their_buckets(spark):
    from quantloom.sources.scratch import bucketed

    before = {t.name for t in spark.catalog.listTables()}
    rows = spark.range(50).withColumn("k", F.col("id") % 7)
    a, b = bucketed(rows, "id", 4), bucketed(rows.select("id", (F.col("k") + 1).alias("m")), "id", 4)
    both = a.join(b.hint("shuffle_hash"), "id")
    assert {t.name for t in spark.catalog.listTables()} == before
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.where("m = k + 1").count() == 50


def test_asof_join_counts_after_pruning(spark):
    """Counting needs no column, so that the optimizer leaves out all it can."""
    left = spark.createDataFrame([("a", day(k), k) for k in range(8)], "code string, date date, id int")
    facts = spark.createDataFrame([("a", day(k), k, float(k)) for k in range(8)], "code string, available_date date, fact_id int, v double")
    for some, n in ((left, 8), (left.where("false"), 0), (left.where("id = 3"), 1), (left.where("code = 'a'"), 8)):
        assert pit.as_of_join(some, facts, ["v"], ranges=4).count() == n
    assert pit.as_of_join(left, facts.where("false"), ["v"], ranges=4).count() == 8
