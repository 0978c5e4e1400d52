"""Near copies against the likeness of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quantloom.llm import near_copies
from quantloom.llm.common import lower_words


def brute(rows):
    """Least id of each component of five-word Jaccard indexes of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = lower_words((t or "").encode())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def stage(spark, docs):
    return dict(cp.STAGES)["near_copies"](spark, docs, "/root/testdata/sf0.001")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = [r.doc_id for r in stage(spark, docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_edited_copies_chains_and_groups(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, text = [], list(rng.choice(vocabulary, 120))
    line = list(rng.choice(vocabulary, 30))  # in every text of a group below
    for i in range(40):  # a chain: each edited a little more
        rows.append((i, " ".join(text)))
        text = [*text]
        text[int(rng.integers(len(text)))] = f"new{i}"
    base = list(rng.choice(vocabulary, 100))
    for i in range(100, 180):  # a group around one text
        t = [*base]
        for j in rng.integers(0, 100, int(rng.integers(0, 4))):
            t[j] = f"x{i}_{j}"
        rows.append((i, " ".join(t)))
    rows += [(i, " ".join(line + list(rng.choice(vocabulary, 20)))) for i in range(200, 260)]
    rows += [(300, "a b c"), (301, "A  b c"), (302, "a b"), (303, ""), (304, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in stage(spark, docs).collect()} == brute(rows)
    assert stage(spark, docs.limit(0)).count() == 0


def test_group_whose_least_are_unlike_makes_few_pairs(spark, monkeypatch):
    """Texts that are alike to each other, but not to the first ones with their shingles, come together without all their pairs."""
    compared = []
    plain = near_copies.alike
    monkeypatch.setattr(near_copies, "alike", lambda pairs, sets: (compared.append(pairs.count()), plain(pairs, sets))[1])
    words = [f"w{k}" for k in range(150)]

    def edited(i, places):
        return " ".join(f"x{i}y{k}" if k in places else w for k, w in enumerate(words))

    texts = [edited(i, {7 + i, 40 + i, 75 + i, 110 + i, 140 - i}) for i in range(10)] + [edited(i, {(i * 37) % 140 + 5}) for i in range(10, 90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    left = sorted(r.doc_id for r in near_copies.one_of_near_copies(docs).collect())
    sets = [{" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert left == sorted(set(root)) and sum(compared) < 1200


def test_texts_are_not_moved_to_leave_out_copies(spark):
    """However many rows stay, those that stay are told apart where they lie."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(10**9, size=400))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts + texts[:60])], "doc_id long, text string, source string").repartition(4)
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = near_copies.one_of_near_copies(docs)
        before = moved()
        assert sorted(r.doc_id for r in out.collect()) == list(range(300)) and out.columns == docs.columns
        assert moved() - before < sum(map(len, texts)) / 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_picked_settles_rows_at_places_of_both(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MARKS", 128)
    rows = spark.range(5000).select((F.col("id") * 7 + (F.col("id") % 3) * (1 << 33)).alias("__row"), F.col("id").cast("string").alias("text"))
    for condition in ("false", "true", "__row % 10 = 0", "__row % 10 != 0", "__row = 7 + (1L << 33)"):
        chosen = rows.where(condition)
        got = near_copies.picked(rows, chosen.select("__row"))
        assert got.columns == rows.columns and sorted(got.collect()) == sorted(chosen.collect())
