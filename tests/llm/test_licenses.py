"""License scans against counting every block."""

import random
import re

import pyarrow as pa

from quantloom.llm.licenses import LICENSES, PHRASES, Scanner, Template, find_licenses, scan_documents, word_counts
from quantloom.llm.oracles import license_scan

DATA = "/root/testdata/sf0.001"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def blocks(text, template):
    """(start, share) of every block that begins at one of the template's words and meets it."""
    words, own = words_of(text), set(template.words)
    out = []
    for s, w in enumerate(words):
        block = words[s : s + template.block]
        shared = own & set(block)
        if w in own and len(shared) >= template.needed and set(template.must) <= shared and not set(template.never) & set(block) and (not template.ordered or block == template.words):
            out.append((s, len(shared) / len(own)))
    return out


def digest(i, text):
    base = sorted((s, t.label) for t in PHRASES for s, _ in blocks(text, t))
    all_ = [(t.label, share) for t in (*PHRASES, *LICENSES) for _, share in blocks(text, t)]
    join = lambda x: ",".join(sorted(set(x)))
    return (i, len(words_of(text)), len(base), base[0][0] if base else None, base[-1][0] if base else None, join(x for _, x in base), join(x for x, _ in all_), max((s for _, s in all_), default=0.0))


def made(n=150, seed=3):
    """Texts with licenses whole, edited, cut and mixed with each other."""
    rng = random.Random(seed)
    pool = sorted({w for t in LICENSES for w in t.words}) + ["zebra", "mit", "straße", "漢字"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = list(rng.choice((*PHRASES, *LICENSES)).words)
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = rng.choices(pool, k=rng.randrange(2))
                words = words or ["mit"]
            parts += words + rng.choices(pool, k=rng.choice([0, 1, 5, 30]))
        out.append(" ".join(w.upper() if rng.random() < 0.1 else w + rng.choice(["", ".", ",", "\n"]) for w in parts))
    return out


EDGES = [None, "", "mit", "under the mit license", "Under THE\tMIT-License!", "under the mit  license under the mit license version 2", "cc by nc cc by nc", "apache license version 2.0", "under the mitlicense", "license " * 3000 + "released under the mit license", "released under the bsd license", "GNU Lesser General Public License version 3", "é under the mit license"]


def test_scan_equals_counting_every_block(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [(i, t) for i, t in enumerate(made() + EDGES)] + [(None, "cc by nc"), (3, "cc by nc"), (3, "cc by nc")]
    df = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted((digest(r.doc_id, r.text) for r in df.collect()), key=repr)
    assert sorted((tuple(r) for r in scan_documents(df).collect()), key=repr) == want
    assert sum(bool(x[6]) for x in want) > 100


def test_sql_equals_scan_on_edited_texts(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame(list(enumerate(made(60, 8) + EDGES)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r.doc_id for r in docs.collect()], "text": pa.array([r.text for r in docs.collect()], pa.string())}))
    assert sorted(con.sql(license_scan()).fetchall()) == sorted(tuple(r) for r in scan_documents(docs).collect())


def test_blocks_are_whole_in_any_order_of_words():
    texts = made(80, 9)
    for seed in range(3):
        rng = random.Random(seed)
        counts = {w: rng.randrange(100) for t in LICENSES for w in t.words}
        n, found = Scanner((*PHRASES, *LICENSES), counts).scan(pa.array(texts))
        assert n.tolist() == [len(words_of(t)) for t in texts]
        for text, got in zip(texts, found, strict=True):
            assert {f["label"] for f in got} == {t.label for t in (*PHRASES, *LICENSES) if blocks(text, t)}


def test_spans_of_blocks_that_overlap(spark):
    t = Template("x", "one two three four five", least=60)
    df = spark.createDataFrame([(1, "one two three zz one two three four five zz zz zz zz zz zz zz one two four", 5, "a")], "doc_id long, text string, n_words int, `a.b` string")
    r = find_licenses(df, [t]).first()
    assert [(f.start, f.length, f.share) for f in r.licenses] == [(1, 8, 1.0), (16, 3, 0.6)] and r["a.b"] == "a" and r.n_words == 19
    assert find_licenses(df.limit(0), [t]).collect() == []


def test_word_counts(spark):
    df = spark.createDataFrame([(1, "mit MIT, mit"), (2, None), (3, "license")], "doc_id long, text string")
    assert word_counts(df, ["mit", "license", "none"]) == {"mit": 3, "license": 1, "none": 0}
