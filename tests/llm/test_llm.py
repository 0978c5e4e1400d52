"""The training-data operators: brute force on small tables, and edges (nulls, empty and long texts, ties, repeats, extra columns)."""

import binascii
import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm import decontamination, langid, lm_scores, packing, quality, sharding, simhash, sketches, token_counts, toxicity
from quantloom.llm.common import labelled_sample, tokens_of
from quantloom.llm.components import connected_components

DATA = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
EDGES = [(1, "Same text, twice."), (2, "Same text, twice."), (3, ""), (4, None), (5, "x"), (6, "é " * 30_000), (None, "no id here"), (2, "Same text, twice."), (7, " \n\t "), (8, "<|endoftext|> it's <|startoftext|>")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def edges(spark, n=len(EDGES)):
    """Edge rows with extra columns that clash with what operators add."""
    rows = [(i, t, "en", "s", 1, 0.5, 9, "c", 3, 4) for i, t in EDGES[:n]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, size long, law string, part int, fp long")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# 1 token counts


def test_token_counts_equal_the_library(spark, docs, texts):
    library = Tokenizer.from_file(WORD)
    for r in token_counts.count_tokens(docs, WORD).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_token_counts_of_random_and_edge_texts(spark):
    library, own = Tokenizer.from_file(WORD), token_counts.counter(WORD)
    rng = random.Random(3)
    parts = [*"abretvlmsd''''. \n\t1²漢ßéÉİΣς!?\x1c", "<|endoftext|>", "<|startoftext|>", "  ", " the", "don't", "'re", "we'll", "'LL", "ation"]
    many = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(2000)] + ["a" * 5000, "'" * 700, "ab'r" * 300]
    assert own.counts(many).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in many]
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(edges(spark), WORD).collect())
    assert got == sorted((i or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGES)
    assert token_counts.count_tokens(edges(spark).limit(0), WORD).count() == 0


def test_token_counts_of_every_code_point():
    library, own = Tokenizer.from_file(WORD), token_counts.counter(WORD)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    many = [" ".join(f"{c}'s ab{c}cd !{c}1" for c in points[at : at + 256]) for at in range(0, len(points), 256)]
    assert own.counts(many).tolist() == [len(e.ids) for e in library.encode_batch(many, add_special_tokens=False)]


def test_token_counts_of_long_runs(monkeypatch):
    library, own = Tokenizer.from_file(WORD), token_counts.counter(WORD)
    rng = random.Random(4)
    many = ["a" * 1_000_000, "ab" * 40_000 + "c", "'" * 5000, "é" * 3000, "x" * 511, "x" * 513, *["".join(rng.choices(k, k=20_000)) for k in ("etaoin", "abcdefghijklmnopqrstuvwxyz", "aé漢")]]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in many]
    assert own.counts(many).tolist() == want
    monkeypatch.setattr(token_counts, "ROUNDS", 0)  # the way without closed maps
    assert own.counts(many[1:]).tolist() == want[1:]
    monkeypatch.setattr(token_counts, "MOST_TRANSITIONS", 10)
    assert own.counts(many[4:6] * 3).tolist() == want[4:6] * 3


def test_chunk_maps_compose_to_a_sequential_run():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 10, 3000).astype(np.uint8)
    nxt, out = token_counts.word_transducer()
    state, starts = 0, set()
    for i, c in enumerate([*classes, 0]):
        o, state = out[state, c], nxt[state, c]
        starts |= ({i} if o & token_counts.HERE else set()) | ({i - 1} if o & token_counts.BEFORE else set())
    assert set(np.flatnonzero(token_counts.word_starts(classes))) == starts


# 2, 4, 8 classifiers


def toy_labels(spark, docs, word="quux"):
    rows = [(i, f"{'plain words here and there ' * 3}{i} {word if i % 2 else 'fine'} more") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d, labels(spark, [(i, 1 - i % 2, i % 2) for i in range(200)])


def test_toxicity_learns_words_and_holds_out(spark, docs):
    d, lab = toy_labels(spark, docs)
    got = toxicity.detect_documents(d, lab).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95 and all((r.score >= 0.7) == (r.predicted == 1) for r in got)
    # labels of the held-out fold are never read
    turned = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r.doc_id, r.score) for r in toxicity.detect_documents(d, turned).collect()) == sorted((r.doc_id, r.score) for r in got)


def test_toxicity_edges(spark):
    for lab in (labels(spark), labels(spark, [(1, None, None), (2, 1, 1), (3, 1, 0), (5, 0, 0), (99, 1, 1)])):
        got = toxicity.detect_documents(edges(spark), lab).collect()
        assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.detect_documents(edges(spark).limit(0), labels(spark)).count() == 0


def test_toxicity_logits_agree_text_by_text():
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, 1 << 36, n) for n in (5, 1, 40, 3)] * 5
    m = toxicity.train_filters(codes, np.array([0, 1, 0, 1] * 5), epochs=1)
    one = [toxicity.logits(m, [c])[0] for c in codes]
    assert np.allclose(toxicity.logits(m, codes), one, atol=1e-4)


def test_toxicity_logits_equal_a_plain_convolution():
    rng = np.random.default_rng(3)
    words = [f"word{i}".encode() for i in range(60)]
    h = toxicity.WordHashes()
    codes = [h.codes([words[j] for j in rng.integers(0, 60, n)]) for n in rng.integers(1, 30, 40)]
    m = toxicity.train_filters(codes, np.arange(40) % 2, epochs=2)
    keys = [k.tolist() for k in m.keys]

    def vector(c):
        if c is None:
            return [0.0] * (2 * toxicity.DIM)
        both = [int(c) >> toxicity.BITS, int(c) & (toxicity.ROWS - 1)]
        return [float(v) for t, k, r in zip(m.tables, keys, both, strict=True) for v in (t[k.index(r) + 1] if r in k else t[0])]

    for c, got in zip([*codes, np.zeros(0, np.int64)], toxicity.logits(m, [*codes, np.zeros(0, np.int64)]), strict=True):
        want = m.bias
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for at in range(len(c) + 1):  # a window may reach beyond the text's end
                    x = [v for i in range(w) for v in vector(c[at + i] if at + i < len(c) else None)]
                    if at < len(c):
                        best = max(best, m.shift[k][f] + sum(a * b for a, b in zip(x, m.filters[k][:, f], strict=True)))
                want += best * m.out[k * toxicity.FILTERS + f]
        assert got == pytest.approx(want, abs=1e-3)


def test_toxicity_of_held_out_labels(spark):
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.detect_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), lab).join(lab, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    toxic, clean = [r.predicted for r in got if r.toxic], [r.predicted for r in got if not r.toxic]
    assert len(toxic) > 30 and np.mean(toxic) > 0.9 and np.mean(clean) < 0.02


def test_toxicity_groups_are_languages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200").select("text", "lang").collect()
    h = toxicity.WordHashes()
    codes = [h.codes(toxicity.words_of(r.text.encode())) for r in rows]
    g = toxicity.Groups.learn(codes)
    by = collections.defaultdict(collections.Counter)
    for c, r in zip(codes, rows, strict=True):
        by[g.of(c)][r.lang] += 1
    assert sum(max(c.values()) for c in by.values()) > 0.85 * len(rows) and len(by) >= 4
    assert g.of(np.zeros(0, np.int64)) == toxicity.GROUPS


def test_labels_of_repeated_ids(spark):
    lab = labels(spark, [(1, 0, 0), (1, 1, 1), (1, None, None), (2, 0, 0), (2, 0, 0)])
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "doc_id long, text string")
    got = labelled_sample(docs, lab, "toxic", F.lit(True), 5).collect()
    assert sorted((r.doc_id, r.y, r.text) for r in got) == [(1, 1, "a"), (2, 0, None)]


def test_quality_dual_descent_solves_its_problem():
    """The gap between the primal and the dual objective, both worked out plainly, is zero only at the solution."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(200, rng.integers(1, 30), replace=False)) for _ in range(120)]
    y = (rng.random(120) < 0.3).astype(int)
    scale = quality.ratios(rows, y)
    counts = [[sum(f in set(r.tolist()) for r, k in zip(rows, y, strict=True) if k == c) + 1 for f in range(200)] for c in (0, 1)]
    rest = quality.WIDTH - 200
    assert np.allclose(scale[:200], [math.log(b / (sum(counts[1]) + rest)) - math.log(a / (sum(counts[0]) + rest)) for a, b in zip(*counts, strict=True)])
    w, b = quality.dual_descent(rows, y, scale, 1.0, 4000)
    x = np.zeros((120, 201))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / math.sqrt(len(r))
    x[:, 200] = 1
    sign, v = np.where(y == 1, 1.0, -1.0), np.r_[w[:200], b]
    upper = len(y) / (2 * np.bincount(y))[y]
    primal = v @ v / 2 + (upper * np.maximum(0, 1 - sign * (x @ v))).sum()
    # the dual by a plain projected gradient
    a, q = np.zeros(120), (x * sign[:, None]) @ (x * sign[:, None]).T
    for _ in range(20_000):
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, upper)
    assert primal == pytest.approx(a.sum() - a @ q @ a / 2, rel=2e-3)


def test_quality_learns_and_holds_out(spark, docs):
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.rate_documents(big, lab).join(lab, "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    got = quality.rate_documents(edges(spark), labels(spark, [(2, 1, 1), (3, 0, 0), (5, None, 0)])).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 and (r.score >= 0.3) == (r.predicted == 1) for r in got)
    assert all(r.predicted == 1 for r in quality.rate_documents(edges(spark), labels(spark)).collect())


def test_quality_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(np.arange(50) + (60 if i % 2 else 0), 10, replace=False)) for i in range(80)]
    y = np.arange(80) % 2
    m = quality.fit(rows, y)
    assert ((m.score(m.margins(rows)) >= 0.3) == (y == 1)).all()


def test_language_of_held_out_documents(spark, docs):
    got = langid.identify_documents(docs).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_language_edges(spark):
    got = collections.defaultdict(set)
    for r in langid.identify_documents(edges(spark)).collect():
        got[r.doc_id].add(r.lang_pred)
    assert got[3] == got[4] == got[7] == {"und"} and got[5] == {"en"}
    none = edges(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify_documents(none).collect()} == {"und"}
    assert langid.identify_documents(edges(spark).limit(0)).count() == 0


def test_language_equals_a_plain_kernel_ridge_regression():
    """With every text a landmark, Nyström features give kernel ridge regression on explicit n-gram sets."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcd efg" if i % 3 else "efgh xyz", k=40)) for i in range(30)]
    langs = ["p" if i % 3 else "q" for i in range(30)]

    def grams(t):
        b, out = b" " + b" ".join(t.encode().split()) + b" ", set()
        for n in langid.SPECTRUM:
            for i in range(len(b) - n + 1):
                h = 0
                for c in b[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ (c + 1)
                out.add(((h + n) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - langid.BITS)
        return out

    sets = [grams(t) for t in texts]
    k = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    x = np.zeros((30, langid.BUCKETS), np.float32)
    for row, t in zip(x, texts, strict=True):
        langid.presence(langid.letters_only(t), row)
    assert [set(np.flatnonzero(r).tolist()) for r in x] == sets
    m = langid.fit(x, langs, landmarks_each=30)
    # explicit features of the kernel, an unpenalized bias, weighted least squares
    value, vector = np.linalg.eigh(k)
    phi = vector[:, value > 1e-6 * value.max()] * np.sqrt(value[value > 1e-6 * value.max()])
    y = np.array([[1.0 if v == name else -1.0 for name in ("p", "q")] for v in langs])
    w = np.array([1 / langs.count(v) for v in langs]) / 2
    design = np.c_[phi, np.ones(30)] * np.sqrt(w)[:, None]
    penalty = np.c_[np.eye(phi.shape[1]) * math.sqrt(langid.RIDGE / 2), np.zeros(phi.shape[1])]
    solved = np.linalg.lstsq(np.r_[design, penalty], np.r_[y * np.sqrt(w)[:, None], np.zeros((phi.shape[1], 2))], rcond=None)[0]
    assert np.allclose(m.decide(x), np.c_[phi, np.ones(30)] @ solved, atol=1e-3)


def test_all_languages_are_learned(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(90):
        own = rng.sample(letters, 4)
        rows += [(k * 100 + i, " ".join("".join(rng.choices(own, k=5)) for _ in range(30)), f"l{k}") for i in range(6)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(m.languages) == 90 and len(m.landmarks) <= langid.MOST_LANDMARKS


def test_presence_kernel_is_a_normalized_intersection():
    rows = np.zeros((2, langid.BUCKETS), np.float32)
    langid.presence(b" abc ", rows[0])
    langid.presence(b" abd ", rows[1])
    both = (rows[0] * rows[1]).sum()
    assert langid.kernel(rows[:1], rows[1:])[0, 0] == pytest.approx(both / math.sqrt(rows[0].sum() * rows[1].sum()))


# 3 language model


def base_of(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]) for i, t in rows]
    c = collections.Counter(w for i, ws in words if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in words]


@pytest.mark.parametrize("kind", ["table", "edges"])
def test_language_model_base_counts(spark, docs, texts, kind):
    df, rows = (docs, list(texts.items())) if kind == "table" else (edges(spark), EDGES)
    got = lm_scores.score_documents(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:4], round(r[4], 6))
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(mine, sorted(base_of(rows), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_language_model_learns(spark):
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(60)]
    d = spark.createDataFrame([(i, " ".join(rng.choice(words[j % 2 :: 2]) for j in range(300))) for i in range(120)], "doc_id long, text string")
    got = [r for r in lm_scores.score_documents(d).collect() if r.held_out]
    assert np.mean([r.score / r.n_tokens for r in got]) > np.mean([r.base_score / r.n_tokens for r in got])
    assert lm_scores.score_documents(d.limit(0)).count() == 0


def test_language_model_bits_of_a_code_sum_to_one():
    first, nodes, bits, _, odds = lm_scores.huffman([5, 1, 3, 2, 2])
    assert odds[1] == pytest.approx(math.log(8 / 5)) and len(odds) == 5
    p = {int(n): 0.3 + 0.05 * i for i, n in enumerate(sorted(set(nodes)))}
    total = sum(np.prod([p[int(n)] if b else 1 - p[int(n)] for n, b in zip(nodes[first[s] : first[s + 1]], bits[first[s] : first[s + 1]], strict=True)]) for s in range(5))
    assert total == pytest.approx(1)


def test_language_model_mixes_and_refines_on_every_bit():
    words = [(f"w{i}".encode(), 4 + 400_000 // (i + 1)) for i in range(40_000)]
    codes = lm_scores.make_codes(words, sum(c for _, c in words), len(words), 100)
    length = np.diff(lm_scores.huffman([101, 1] + [c for _, c in words])[0])
    t = tokens_of(pa.array([" ".join(f"w{i}" for i in range(39_000, 40_000)), " ".join(["w0", "w39999"] * 9000)]))
    symbol = lm_scores.symbols(t, codes.places(t.distinct), codes)
    steps = list(lm_scores.word_steps(t, codes, symbol, lm_scores.word_hashes(t)))
    bits = np.bincount(np.concatenate([s[0] for s in steps]), minlength=len(symbol))
    assert length.max() > 14 and (bits == length[symbol]).all() and len(steps) > 2
    counts, mixer = lm_scores.new_counts(0), lm_scores.Mixer.new()
    assert lm_scores.learned(iter(steps), 0, codes.words[2], counts, mixer) == bits.sum() == mixer.seen[0].sum()
    assert counts.sum() == 2 * bits.sum()


def test_language_model_counts_stay_exact_and_tables_merge():
    half = lm_scores.SLOTS // 2
    steps = lambda kind: iter([(np.zeros(1000, np.int64), np.ones(1000, np.int64), np.full((2, 1000), kind * half), np.ones(1000, np.uint8), np.zeros(1000, np.int64))])
    counts = lm_scores.new_counts(1)
    counts[:2] = 1 << 24
    lm_scores.learned(steps(1), 1, np.zeros(3, np.float32), counts, lm_scores.Mixer.new())
    assert counts[:2].tolist() == [1 << 24, (1 << 24) + 2000]
    part = counts[: 2 * lm_scores.SLOTS // lm_scores.PARTS]
    total = lm_scores.unpacked(0, lm_scores.pack_array(part)) + lm_scores.unpacked(0, lm_scores.pack_array(part.astype(np.int64) << 30))
    assert total[0] == (1 << 24) + (1 << 54)
    small = lm_scores.new_counts(0)
    small[:2] = 3, 15_999
    for _ in range(40):  # never beyond 16 bits, and the odds stay
        lm_scores.learned(steps(0), 0, np.zeros(3, np.float32), small, lm_scores.Mixer.new())
        assert 7_000 < small[1] < 30_000 and small[0] in (1, 2, 3)
    assert lm_scores.unpacked(0, lm_scores.pack_array(small[: 2 * lm_scores.SLOTS // lm_scores.PARTS]))[:2].tolist() == small[:2].tolist()


def naive_scores(rows, codes, table, mixer):
    """log10 of each text's mixed probability, a bit at a time; and its segments (key words, words), each with its share of the score.

    Costs are those of the FINE steps of the mixed log odds, in the 32 bits that the operator works in.
    """
    costs = lm_scores.cost_tables(mixer)
    m32, k1, k2 = (1 << 32) - 1, 0x9E3779B1, 0x85EBCA6B
    mixed = lambda *parts: functools.reduce(lambda h, p: (lambda x: x ^ x >> 15)((h ^ p) * k1 & m32), parts, 0)

    def bits(kind, code, symbol, contexts, gate):
        first, steps, own = code
        total = 0.0
        for j, at in enumerate(range(first[symbol], first[symbol + 1])):
            node, g = int(steps[at]) >> 5, min(j, lm_scores.GATES - 1) if gate is None else gate
            mix = np.float32(0) + np.float32(mixer.weights[kind][g, 0, lm_scores.LEVELS - 1]) * own[node]
            for i, c in enumerate(contexts):
                start, n = lm_scores.SHARES[kind][i]
                h = (c ^ node * k2 & m32) * k1 & m32
                h = (h ^ h >> 15) * k2 & m32
                v = int(table[h * n * (lm_scores.SLOTS // 16) // (1 << 32) + start * (lm_scores.SLOTS // 16)])
                mix += np.float32(mixer.weights[kind][g, i + 1, v & 15]) * np.float32(((v >> 4) - 2048) * (24 / 4096))
            mix = min(np.float32(11), max(np.float32(-11), mix))
            step = int(np.rint((mix + np.float32(11)) * np.float32((lm_scores.FINE - 1) / 22)))
            total += float(costs[kind][(g * 2 + (int(steps[at]) & 1)) * lm_scores.FINE + step])
        return total

    out, parts = [], []
    place = {w: i + 2 for i, w in enumerate(codes.frequent[: codes.coded])}
    for _, text in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        h = [xxhash.xxh3_64_intdigest(w) for w in words] + [0]
        cost = []
        for i in range(len(words) + 1):
            b1, b2 = h[i - 1] & m32 if i > 0 else 0, h[i - 2] & m32 if i > 1 else 0
            symbol = 0 if i == len(words) else place.get(words[i], 1)
            c = bits(0, codes.words, symbol, [mixed(1, b1), mixed(2, b1, b2)], None)
            if symbol == 1:
                front = 0
                x = [0] * 5 + [l + 1 for l in words[i]] + [257]
                for j in range(len(words[i]) + 1):
                    a, b, d, e, f = x[j + 4 : j - 1 if j else None : -1][:5]
                    two = mixed(a, b)
                    contexts = [mixed(11, two), mixed(12, two, d, e), mixed(13, front, j), mixed(14, two, min(j, 15))]
                    c += bits(1, codes.letters, x[j + 5] - 1, contexts, min(j, lm_scores.GATES - 1))
                    front = front + (x[j + 5] * k2 & m32 ^ (x[j + 5] >> 3) * pow(0x01000193, j + 1, 1 << 32) & m32) & m32
            cost.append(c)
        out.append(sum(cost))
        k64, m64, found = 0x9E3779B97F4A7C15, (1 << 64) - 1, []
        marks = [i for i in range(2, len(words)) if ((((h[i] * k64 & m64) ^ h[i - 1]) * k64 & m64) >> 40) % lm_scores.SEGMENT == 0]
        for i, then in zip(marks, [*marks, len(words)][1:], strict=True):
            to = min(then, i + lm_scores.LONGEST)
            found.append((tuple(words[i - 2 : i + 1]), (*words[i + 1 : to + 1], to == len(words)), sum(cost[i + 1 : to + 1])))
        parts.append(found)
    return out, parts


def test_language_model_scores_equal_brute_force(spark, texts, monkeypatch):
    """Every bit, every segment and every forecast told one by one, with the model that training gives."""
    rows = [(i, t[:1500]) for i, t in list(texts.items())[:24]] + [(900, None), (901, ""), (902, "é " * 400), (None, texts[3][:1500] + " tail"), (4, texts[3][:1500])]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).cache()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    models, train = [], lm_scores.train
    monkeypatch.setattr(lm_scores, "train", lambda docs, vocabulary, codes: models.append((codes, *train(docs, vocabulary, codes))) or models[0][1:])
    got = collections.defaultdict(list)
    for r in lm_scores.score_documents(d).collect():
        got[r.doc_id, r.n_tokens].append((r.mixed_score, r.score))
    mixed, parts = naive_scores(rows, *models[0])
    follow = collections.defaultdict(collections.Counter)
    for (i, _), found in zip(rows, parts, strict=True):
        for key, words, _ in found:
            follow[key].update([] if held(i) else [words])

    def seen_class(n, m):
        return min(math.ceil(math.log2(n)), lm_scores.OFTEN - 1) * lm_scores.SURE + 4 * n // m

    tie = {k for k, c in follow.items() if sorted(c.values())[-2:].count(max(c.values(), default=0)) > 1}  # the best one goes by its hash
    right, wrong = collections.Counter(), collections.Counter()
    for c in filter(None, follow.values()):
        n, m = max(c.values()), sum(c.values())
        right.update({seen_class(n - 1, m - 1): n} if n > 1 else {})
        wrong.update({seen_class(n, m - 1): m - n} if m > n else {})
    checked = 0
    for (i, t), cost, found in zip(rows, mixed, parts, strict=True):
        want, sure = cost, True
        for key, words, own in found:
            c = follow[key]
            if not c:
                continue
            sure &= key not in tie
            best, n = c.most_common(1)[0]
            me = 0 if held(i) else 1
            n -= me if best == words else 0
            if n > 0:
                k = seen_class(n, sum(c.values()) - me)
                p = min(0.999, (right[k] + 0.1) / (right[k] + wrong[k] + 1)) if right[k] + wrong[k] else 0.1
                want += math.log10(p + (1 - p) * 10**own) - own if best == words else math.log10(1 - p)
        scores = got[i, len((t or "").split()) + 1]
        assert any(a == pytest.approx(cost, rel=1e-6) for a, _ in scores), (i, cost, scores)
        if sure:
            checked += len(found)
            assert any(b == pytest.approx(want, rel=1e-6) for _, b in scores), (i, want, scores)
    assert checked > 50


def test_language_model_on_held_out_texts(spark, monkeypatch):
    """The whole score beats the base. The mixing alone beats it on words that training texts have, and is no worse by token than when this was written."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models, train = [], lm_scores.train
    monkeypatch.setattr(lm_scores, "train", lambda docs, vocabulary, codes: models.append((codes, *train(docs, vocabulary, codes))) or models[0][1:])
    rows = lm_scores.score_documents(d)
    got = rows.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("mixed_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] and got[2] / got[3] > -4.37
    costs = lm_scores.Costs(*models[0])
    t = tokens_of(pa.array([r.text for r in d.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]))
    place = costs.codes.places(t.distinct)
    c = np.where(t.number < 0, costs.codes.ends, costs.codes.often[place][t.number])
    mine, base = costs.of(t, place, lm_scores.word_hashes(t))[c > 0].mean(), np.log10((c[c > 0] + 0.5) / costs.codes.total).mean()
    assert mine > base + 0.1


def test_language_model_tells_texts_that_occur_twice(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=120))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows[:60]]
    got = {r.doc_id: r.bits_per_byte for r in lm_scores.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    twice = [got[i] for i in range(60) if not held(1000 + i)]
    assert max(twice) < min(got[i] for i in range(60, 300))


# 5 sketches


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(0, 2**64, 5000, dtype=np.uint64)
    a[:2500] = b[:2500]
    x, y = sketches.sketch(a), sketches.sketch(b)
    assert (sketches.merge(x, y) == sketches.sketch(np.concatenate([a, b]))).all()
    assert sketches.resemblance(x, y) == pytest.approx(1 / 3, abs=0.12) and sketches.containment(x, y) == pytest.approx(0.5, abs=0.2)
    assert sketches.distinct(x) == pytest.approx(5000, rel=0.3) and sketches.sketch(np.repeat(a[:3], 900)).size == 3
    assert (sketches.from_text(sketches.to_text(x)) == x).all()


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_edited_texts_follow_falling_ids(spark, docs, texts, parts):
    got = {r.doc_id: r for r in sketches.fingerprint_edits(docs, parts).collect()}
    ids = sorted(texts, reverse=True)
    for i, d in enumerate(ids):
        t, n = texts[d], texts[ids[(i + 1) % len(ids)]]
        k = len(t) // 3
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest() and got[d].n_chars == len(t)
        a, b = (set(sketches.shingle_hashes(x.encode()).tolist()) for x in (t, t[: len(t) - k] + n[:k]))
        assert abs(got[d].near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.2


def test_sketch_edges(spark):
    got = sketches.fingerprint_edits(edges(spark), 3).collect()
    assert len(got) == len(EDGES) and {r.fingerprint for r in got if r.doc_id in (3, 4, 7)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    one = sketches.fingerprint_edits(edges(spark, 1), 2).first()
    assert one.near_next == 1.0 and sketches.fingerprint_edits(edges(spark).limit(0), 2).count() == 0


def test_sketch_likeness_against_all_shingles(spark, docs, texts):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4)) if w}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    ids = sorted(texts, reverse=True)
    off = []
    for r in sketches.fingerprint_edits(docs, 4).collect():
        t, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        a, b, c = shingles(t), shingles(after), shingles(t[: len(t) - len(t) // 3] + after[: len(t) // 3])
        off += [abs(r.near_next - like(a, b)), abs(r.near_edited - like(a, c))]
        assert abs(r.n_shingles - len(a)) <= 0.35 * len(a)
    assert max(off) < 0.2 and np.mean(off) < 0.03


@pytest.mark.parametrize("least_hot", [2, 1000])
def test_hot_and_null_ids_are_dealt_over_ranges(spark, least_hot):
    rows = [(None if i % 2 else i, "one text of all of these rows here" if i % 3 == 0 else f"text {i} has words of its own") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = sketches.ordered_neighbours(d, 8, least_hot)
    assert len({r.part for r in dealt.where("doc_id IS NULL AND NOT donor").collect()}) > 2
    moved = dealt.where("NOT donor").agg(F.sum("times"), F.count("*")).first()
    assert moved[0] == 600 and (moved[1] == 501) == (least_hot == 2)
    got = sketches.fingerprint_edits(d, 8, least_hot).collect()
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((i, len(t)) for i, t in rows)
    # one chain: every row but the last of its kind has the next one's text
    same = [r for r in got if r.doc_id is None and r.n_chars == 34]
    assert sum(r.near_next == 1.0 for r in same) >= 99 and len(same) == 100


def test_places_in_long_lists_of_edges(spark):
    edges_ = sorted(f"{i:05d}" for i in range(0, 3000, 3))
    got = spark.range(3000).select("id", sketches.place_of(F.lpad(F.col("id").cast("string"), 5, "0"), edges_).alias("p")).collect()
    assert all(r.p == r.id // 3 for r in got)


def test_merged_sketches_equal_sketch_of_all(spark, docs):
    fps = sketches.fingerprint_edits(docs, 2).join(docs.select("doc_id", "lang"), "doc_id")
    got = {r.lang: r.merged for r in sketches.merge_sketches(fps, ["lang"]).collect()}
    want = {}
    for r in docs.select("lang", "text").collect():
        want.setdefault(r.lang, []).append(sketches.shingle_hashes(r.text.encode()))
    assert {k: np.array(v).view(np.uint64).tolist() for k, v in got.items()} == {k: sketches.sketch(np.concatenate(v)).tolist() for k, v in want.items()}


# 6 shards


def test_shards_are_even_whole_and_gapless(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.histogram_sort(d).toPandas()
    assert len(got) == 1000 and sorted(got.shard.unique()) == list(range(8))
    size = got.groupby("shard")["size"].sum()
    assert size.max() / size.min() < 1.05
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (got.groupby("text_crc32").shard.nunique() == 1).all()


def test_splitters_equal_a_sorted_cut(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << sharding.KEY_BITS, 4000)
    keys[:900] = keys[0]  # a group larger than a shard
    size = rng.integers(1, 2000, 4000)
    rows = [(int(k), int(x), int(n)) for k, x, n in zip(keys, rng.integers(0, 1 << sharding.KEY_BITS, 4000), size, strict=True)]
    share = int(size.sum()) / 8
    ordered = sorted(rows)
    for i, cut in enumerate(sharding.find_splitters(spark.createDataFrame(rows, "k1 long, k2 long, size long"), int(size.sum()), 8), 1):
        below = sum(n for k1, k2, n in ordered if (k1, k2) < cut)
        assert abs(below - i * share) <= max(2000, 0.02 * share)


def test_shards_split_a_hot_text_and_keep_edges(spark):
    rows = [(i, "hot copy of one text") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(3000)]
    got = sharding.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string"), 4, rows_a_range=100).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert size.max() / size.min() < 1.06
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    got = sharding.histogram_sort(edges(spark)).toPandas()
    assert len(got) == len(EDGES) and set(got[got.doc_id == 4]["size"]) == {1}
    # rows alike in all columns are dealt as well
    rows = [(None, "the same")] * 2000 + [(i, f"text {i}") for i in range(2000)]
    got = sharding.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string"), 4, rows_a_range=100).toPandas()
    assert got.groupby("shard")["size"].sum().agg(["min", "max"]).pct_change().iloc[1] < 0.06
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.histogram_sort(edges(spark).limit(0)).count() == 0


# 7 near duplicates


def brute_components(fps):
    """Smallest id reachable, by comparing all."""
    ids, words = [i for i, _ in fps], np.array([f for _, f in fps], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(words ^ words[i]) <= 2):
            root[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    assert [r.component_id for r in rows] == brute_components([(r.doc_id, int(r.fingerprint, 16)) for r in rows])


@pytest.mark.parametrize("most", [1, 4, 64])
def test_links_join_all_within_two_bits(spark, most):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1) << np.uint64(i) ^ np.uint64(1) << np.uint64(j) for b in base[:6] for i, j in rng.integers(0, 64, (12, 2))]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)])).view(np.int64).tolist()
    links = simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"), most)
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert [got.get(f, f) for f in fps] == brute_components([(f, np.int64(f).view(np.uint64)) for f in fps])


def test_golay_keys_meet_within_one_error():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for flips in (0, 1, 2):
        b = a.copy()
        for _ in range(flips):
            b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
        keys = []
        for x in (a, b):
            r, k = simhash.fuzzy_keys(x)
            keys.append(set(zip(r.tolist(), k.tolist(), strict=True)))
        assert {r for r, _ in keys[0] & keys[1]} == set(range(len(a)))


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert len(got) == 203 and {got[i] for i in range(201)} == {0} and got[1001] == 1000
    assert connected_components(links.limit(0)).count() == 0


def test_fingerprints_bit_by_bit(spark, docs):
    rows = [(r.doc_id, r.text[:3000]) for r in docs.limit(40).collect()] + [(900, None), (901, "a b"), (902, "A\x0bb")]
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert int(got[i], 16) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicate_edges(spark):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(edges(spark)).collect()), key=str)
    assert len(got) == len(EDGES) and {g[2] for g in got if g[0] in (3, 4, 7)} == {3} and {g[1] for g in got if g[0] == 3} == {"0" * 16}
    assert simhash.near_duplicates(edges(spark).limit(0)).count() == 0


# 9 decontamination


def test_smith_waterman_equals_the_table():
    rng = np.random.default_rng(0)
    a, b = [rng.integers(1, 5, rng.integers(1, 12)) for _ in range(40)], [rng.integers(0, 5, rng.integers(1, 20)) for _ in range(40)]
    for x, y, got, lo, hi in zip(a, b, *decontamination.smith_waterman(a, b), strict=True):
        h = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if x[i - 1] == y[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert got == h.max() and (got == 0 or 0 <= lo < hi <= len(y))


def all_pairs(items, texts):
    """(row, item) of all passages at the threshold, every text aligned with every item."""
    ix = decontamination.index_items([(i, t.encode()) for i, t in enumerate(items)])
    out = set()
    for r, t in enumerate(texts):
        w = decontamination.words_of(pa.array([t]))[0][:-1].view(np.int64)
        score, _, _ = decontamination.smith_waterman(ix.words, [w] * len(items))
        out |= {(r, i) for i, s in enumerate(score) if len(ix.words[i]) and s >= 2 * len(ix.words[i]) * decontamination.THRESHOLD}
    return out


def test_leaks_equal_alignment_of_all_pairs(spark, docs, texts):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows, ids = bench.collect(), sorted(texts)
    want = {(ids[r], rows[i].item_id) for r, i in all_pairs([x.text for x in rows], [texts[d] for d in ids])}
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == want and want


def test_leaks_of_edited_copies_equal_alignment_of_all_pairs(spark):
    """Words replaced, dropped and put in, up to half of them; no candidate filter may lose a passage at the threshold."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [vocabulary[min(2999, int(rng.paretovariate(0.7)) - 1)] for _ in range(n)]
    items = [draw(rng.randrange(3, 60)) for _ in range(30)] + [[f"w{i}" for i in range(1, 11)] * 3, [f"w{i}" for i in range(100, 140)]]
    texts = []
    for j in range(240):
        w, share = [], rng.choice([0, 0.1, 0.2, 0.3, 0.4, 0.5])
        for x in items[j % len(items)]:
            r = rng.random()
            w += [] if r < share / 3 else [rng.choice(vocabulary)] if r < share * 2 / 3 else [x, rng.choice(vocabulary)] if r < share else [x]
        texts.append(" ".join(draw(rng.randrange(80)) + w + draw(rng.randrange(80))))
    texts.append(" ".join("other" if k % 3 == 2 else x for k, x in enumerate(items[-1])))  # every third word replaced
    texts.append(" ".join(y for x in items[-1] for y in (x, "other")))  # a word put in after each
    want = all_pairs([" ".join(i) for i in items], texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(d, bench).collect()} == want
    assert {(240, 31), (241, 31)} <= want and len(want) > 200


def test_short_items_go_by_the_same_rule(spark):
    """Items of one to seven words, whole and edited, among words that are rare or in every text."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [rng.sample(vocabulary, n) for n in range(1, 8) for _ in range(5)] + [["plain"], ["plain", "words"], ["w1", "w1"]]
    texts = []
    for j in range(200):
        w = list(items[j % len(items)])
        if j % 3:
            w[rng.randrange(len(w))] = "edited"
        if j % 5 == 0:
            w.insert(rng.randrange(len(w) + 1), "put")
        texts.append(" ".join(["plain words of a text"] + [rng.choice(vocabulary) for _ in range(rng.randrange(4))] + w + ["and an end"]))
    want = all_pairs([" ".join(i) for i in items], texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = decontamination.leaks(d, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and {len(items[i]) for _, i in want} == {1, 2, 3, 4, 5, 6, 7}
    assert all(r.item_words == len(items[r.item_id]) and r.share >= decontamination.THRESHOLD for r in got)


def test_seeds_of_many_items_and_blocks(spark, docs, monkeypatch):
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 40) % 5000).encode()) for i in range(2000)]
    ix = decontamination.index_items(items)
    few = decontamination.rare_seeds(ix, rng.integers(0, 1000, 1 << decontamination.SLOT_BITS))
    assert (few.need >= 1).all() and (few.need >= ix.need - ix.need // 2).all() and set(few.item) == set(ix.item)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    found = lambda: sorted((r.doc_id, r.item_id, r.share) for r in decontamination.leaks(docs, bench).collect())
    whole = found()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 3000)
    assert found() == whole and decontamination.without_leaks(docs, bench).count() == docs.count() - len({r[0] for r in whole})


def test_edited_and_hot_passages_are_found(spark):
    rng = random.Random(1)
    item = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        w = list(item) if i % 3 == 0 else [f"w{rng.randrange(40)}" for _ in range(40)]
        if i % 6 == 0:  # a sixth of the words edited, one dropped
            for k in range(0, 40, 6):
                w[k] = "edited"
            del w[9]
        rows.append((i, " ".join(["before"] * 50 + w + ["after"] * 50).upper()))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(d, bench).collect()} == {(i, 1) for i in range(0, 300, 3)}
    assert decontamination.without_leaks(d, bench).count() == 200


def test_leak_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.leaks(edges(spark), bench).count() == 0
    assert decontamination.leaks(edges(spark).limit(0), bench).count() == 0 and decontamination.leaks(edges(spark), bench.limit(0)).count() == 0
    kept = decontamination.without_leaks(edges(spark), bench)
    assert kept.columns == edges(spark).columns and kept.count() == len(EDGES)


# 10 packing


def check_pieces(rows, want):
    """Every id in one piece, sequences gapless, no padding but to 2048 or a power of two."""
    for d, ids in want.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == binascii.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0


def test_packing_round_trip(spark, docs, texts):
    library = Tokenizer.from_file(BYTE)
    check_pieces(packing.pack_texts(docs, BYTE).collect(), {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()})


def test_packing_edges(spark):
    library = Tokenizer.from_file(BYTE)
    rows = [(i, t) for i, (_, t) in enumerate(EDGES)]
    got = packing.pack_texts(spark.createDataFrame(rows, "doc_id long, text string"), BYTE).collect()
    check_pieces(got, {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows})
    assert packing.pack_texts(edges(spark), BYTE).where("doc_id IS NULL").select("doc_tokens").distinct().count() == 1
    assert packing.pack_texts(edges(spark).limit(0), BYTE).count() == 0


def test_pieces_equal_the_library():
    library, own = Tokenizer.from_file(BYTE), packing.PieceTokens(BYTE)
    rng = random.Random(2)
    parts = [*"ab é1'. \n\t,sß漢<|>\x1c", "<|endoftext|>", "  ", " the", "'s", " heed,", " née."]
    many = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(3000)]
    assert [x.tolist() for x in own.encode(pa.array([*many, None]))] == [library.encode(t, add_special_tokens=False).ids for t in [*many, ""]]


def test_whole_examples_keep_all_limits(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(n), int(n * rng.random())) for i, n in enumerate(rng.integers(1, 300, 500))] + [(900, 5000, 10), (901, None, None)]
    limits = packing.Limits(tokens=512, segments=4, loss_tokens=200)
    got = packing.pack_examples(spark.createDataFrame(rows, "id int, tokens int, loss_tokens int"), limits).toPandas()
    assert sorted(got.id) == sorted(r[0] for r in rows)
    fit = got[~got.oversize].groupby("sequence_id").agg(tokens=("tokens", "sum"), loss=("loss_tokens", "sum"), n=("id", "size"))
    assert (fit.tokens <= 512).all() and (fit.loss <= 200).all() and (fit.n <= 4).all()
    least = max(got[~got.oversize].tokens.sum() / 512, got[~got.oversize].loss_tokens.sum() / 200, len(got) / 4)
    assert len(fit) < 1.25 * least


def test_conversations_keep_all_limits(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    limits = packing.Limits(2048, 8, 1024)
    library = Tokenizer.from_file(BYTE)
    want = collections.defaultdict(lambda: [0, 0])
    for r in conversations.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.conv_id][0] += n
        want[r.conv_id][1] += n if r.role == "assistant" else 0
    got = packing.pack_conversations(conversations, BYTE, limits).toPandas()
    assert {r.id: [r.tokens, r.loss_tokens] for r in got.itertuples()} == dict(want) and len(got) == len(want)
    fit = got[~got.oversize].groupby("sequence_id").agg(tokens=("tokens", "sum"), loss=("loss_tokens", "sum"), n=("id", "size"))
    assert (fit.tokens <= 2048).all() and (fit.loss <= 1024).all() and (fit.n <= 8).all()
    assert ((got[got.oversize].tokens > 2048) | (got[got.oversize].loss_tokens > 1024)).all()
    rows = [(1, 0, "user", None), (1, 1, None, "x y"), (None, 0, "assistant", "z")]
    assert packing.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), BYTE).count() == 2


def test_lm_counts_and_learns_without_an_earlier_model(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and more") for i in range(40)], "doc_id long, text string").repartition(3)
    plain, sent, below = type(docs).mapInArrow, [], []

    def noted(self, f, *a, **b):
        sent.append(f)
        below.append(self._jdf.queryExecution().analyzed().nodeName())
        return plain(self, f, *a, **b)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    vocabulary = lm_scores.written(lm_scores.counted_words(docs))
    lm_scores.train(docs, vocabulary, lm_scores.find_codes(vocabulary, docs.count())[0])
    assert len(sent) == 4 and "MapInArrow" not in below  # two in a row would take two workers a task
    for f in sent:
        lm_scores._costs[:] = "model", object()
        assert not list(f(iter([]))) and lm_scores._costs == [None, None]


def test_language_model_spells_what_words_share_once(monkeypatch):
    """Costs are those of whole spellings, letter by letter, with fewer bits worked on."""
    rng = random.Random(5)
    words = sorted({(f"shared{i % 7}" * (i % 3) + "".join(rng.choices("abé", k=i % 40))).encode() for i in range(3000)} | {b"x" * 9000, b"x" * 9001, b"\xff\x00"}, key=lambda w: rng.random())
    codes = lm_scores.make_codes([(w, 3) for w in words], 3 * len(words), len(words), 10)
    counts, mixer = lm_scores.new_counts(1), lm_scores.Mixer.new()
    lm_scores.learned(lm_scores.letter_steps(words, codes), 1, codes.letters[2], counts, mixer, np.ones(len(words)))
    table = np.concatenate([np.zeros(lm_scores.SLOTS // 2, np.uint16), lm_scores.packed(counts)])
    costs, seen, step_costs = lm_scores.Costs(codes, table, mixer), [], lm_scores.step_costs
    whole = step_costs(lm_scores.letter_steps(words, codes), 1, len(words), codes.letters[2], table, mixer, costs.bits)
    monkeypatch.setattr(lm_scores, "step_costs", lambda steps, *rest: step_costs((seen.append(len(s[0])) or s for s in steps), *rest))
    assert np.allclose(costs.spelling(words), whole, rtol=1e-12, atol=0) and (whole < 0).all()
    assert sum(seen) < 0.9 * sum(len(s[0]) for s in lm_scores.letter_steps(words, codes))
    assert len(costs.spelling([])) == 0
