"""Spelling variants against pairs found by deletions."""

import collections
import random
import re
import zlib

from quantloom.llm.spellings import near_words, light_steps, roots, spelling_variants

DATA = "/root/testdata/sf0.001"


def variants(words, times=10):
    """(word, form, root, n, near words, form's n) of a dict of words and counts."""
    near, holes = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            if (less := w[:k] + w[k + 1 :]) in words:
                near[w].add(less), near[less].add(w)
            holes[w[:k], w[k + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= times * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


def counted(rows):
    found = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def test_variants_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, spelling_variants(docs).collect())) == variants(counted(rows))


def test_variants_of_edge_texts(spark):
    long = "ab" * 20_000
    texts = ["Variants variants VARIANTS variant's variantes xvariants vaariants", None, "", "ÉTERNEL éternel éternels", "×÷×÷×÷× ×÷×÷×÷×", long, long + "c", long, long + "c", "1234567 1234567", "abcdefg-abcdefg_abcdefg abcdefgh"]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts * 3)] + [(3, "variants " * 500), (3, "variants " * 500)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, `a.b` string")
    assert sorted(map(tuple, spelling_variants(df).collect())) == variants(counted(rows))
    assert spelling_variants(df.limit(0)).collect() == []
    assert spelling_variants(df.where("text IS NULL")).collect() == []


def test_near_words_of_dense_sets(spark):
    rng = random.Random(2)
    # few letters: nearly all words are near many, tries are deep and light subtrees meet each other
    words = {"".join(rng.choice("ab漢") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 200) for _ in range(300)}
    df = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(words.items())], "id long, word string, n long").cache()
    got = {r.word: (r.n_near, r.best.word) for r in near_words(df, light_steps(df)).collect()}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    assert got == {w: (len(x), min(x, key=lambda v: (-words[v], v))) for w, x in near.items() if x}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_light_steps_are_few(spark):
    words = [f"{a}{b}{c}{d}" for a in "abcd" for b in "abcd" for c in "abcd" for d in "abcd"] + ["a" * 3000 + "b" * k for k in range(1, 30)]
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    most = max(r["count"] for r in light_steps(df).groupBy("id").count().collect())
    assert most <= 9  # log2 of the words, and the end


def test_roots_follow_long_chains(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(9)]
    got = dict(map(tuple, roots(spark.createDataFrame(forms, "word string, form string"), 10**10, 10).collect()))
    assert got == {f"w{k}": "w9" for k in range(9)}


def test_sql_equals_brute_force_on_edge_texts():
    import duckdb
    import pyarrow as pa

    from quantloom.llm.oracles import spelling_variants as sql

    rows = [(i if i % 7 else None, t) for i, t in enumerate(["Variants variants VARIANTS variantes xvariants vaariants", None, "", "ÉTERNEL éternel éternels", "abcdefg-abcdefg_abcdefg abcdefgh"] * 6)] + [(3, "variants " * 500)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    assert sorted(con.sql(sql()).fetchall()) == variants(counted(rows))
