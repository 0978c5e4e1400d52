"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Each word has two hashed embeddings side by side, so that words that meet in one table differ in the other. Filters of several widths
run over the text, their greatest responses (max pooling) feed a logistic unit. Thresholds are calibrated by language, as the
texts' frequent words group them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, schema, sole_memory, text_bytes, with_columns

#: Rows of each of the two embedding tables, and the columns of each.
BITS = 18
ROWS = 1 << BITS
DIM = 4
#: Widths of the filters, in words, and the filters of each width.
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Training texts of each class at most, those with the least hash of their id.
PER_CLASS = 2000
#: Words in fewer texts than this share of class 1 (or in one) get no embedding, so that chance words aren't learned.
RARE = 0.01
#: What a share of false alarms costs against the same share of misses.
FALSE_COST = 4
#: predicted is score >= THRESHOLD.
THRESHOLD = 0.7
#: Distinct words whose hashes a task remembers.
MOST_WORDS = 300_000

#: Groups of texts by their frequent words, and these words: languages, as the training texts show them (their lang isn't looked at).
GROUPS, SIGNS = 8, 256

_SEPARATE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters (and all beyond ASCII), A-Z lower-cased."""
    return text.translate(_SEPARATE).split()


class WordHashes:
    """Both hashes of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Each word's two table rows, packed."""
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        for w in set(words).difference(known):
            h = zlib.crc32(w)
            known[w] = (h & (ROWS - 1)) << BITS | h >> 32 - BITS
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


@dataclass
class Groups:
    """Frequent words and the weight of each in each group; the last group is that of texts without such words."""

    codes: np.ndarray  # sorted
    weights: np.ndarray  # words x groups

    @staticmethod
    def learn(texts: list[np.ndarray], rounds: int = 20) -> Groups:
        """Spherical k-means over the texts' SIGNS most frequent words; each next group begins with the text that is least like the ones so far."""
        each = [np.unique(c) for c in texts]
        word, n = np.unique(np.concatenate([*each, np.zeros(0, np.int64)]), return_counts=True)
        codes = np.sort(word[np.lexsort((word, -n))[:SIGNS]])
        x = np.stack([np.isin(codes, c, assume_unique=True) for c in each]).astype(np.float64) if len(codes) else np.zeros((0, 0))
        x = x[x.any(axis=1)] if len(x) else x
        if not len(x):
            return Groups(codes, np.zeros((len(codes), 0)))
        x /= np.linalg.norm(x, axis=1)[:, None]
        middle = x[[int((x @ x.mean(axis=0)).argmax())]]
        while len(middle) < GROUPS and (far := (x @ middle.T).max(axis=1)).min() < 0.999:
            middle = np.concatenate([middle, x[[int(far.argmin())]]])
        for _ in range(rounds):
            own = (x @ middle.T).argmax(axis=1)
            sums = np.stack([x[own == k].sum(axis=0) for k in range(len(middle))])
            size = np.linalg.norm(sums, axis=1)[:, None]
            middle = np.where(size > 0, sums / np.maximum(size, 1e-12), middle)
        return Groups(codes, middle.T)

    def of(self, codes: np.ndarray) -> int:
        if not len(self.codes):
            return GROUPS
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = at[self.codes[at] == codes]
        if not len(hit) or not self.weights.shape[1]:
            return GROUPS
        return int((np.bincount(hit, minlength=len(self.codes)) > 0).astype(np.float64).dot(self.weights).argmax())


@dataclass
class ToxicityModel:
    keys: tuple[np.ndarray, np.ndarray]  # of each table: rows of words not rare in training, sorted
    tables: tuple[np.ndarray, np.ndarray]  # their embeddings; the first row is that of all others, zero
    filters: list[np.ndarray]  # for each width: (width * 2 * DIM, FILTERS)
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float
    slope: float = 1.0
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(GROUPS + 1))
    groups: Groups = field(default_factory=lambda: Groups(np.zeros(0, np.int64), np.zeros((0, 0))))

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """For each table, the place of each of its ROWS among the kept embeddings."""
        places = []
        for k in self.keys:
            p = np.zeros(ROWS, np.int32)
            p[k] = np.arange(1, len(k) + 1)
            places.append(p)
        return tuple(places)

    def embed(self, codes: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.concatenate([self.tables[0][places[0][codes >> BITS]], self.tables[1][places[1][codes & (ROWS - 1)]]], axis=1)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Greatest rectified response of every filter over one text's embedded words, and where it was."""
        best, where = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.shift, strict=True):
            r = np.maximum(windows(x, w) @ f + b, 0)
            at = r.argmax(axis=0)
            best.append(r[at, np.arange(FILTERS)])
            where.append(at)
        return np.concatenate(best), where

    def score(self, logit: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The logit against its group's cut, as a value between 0 and 1 that is THRESHOLD at the cut."""
        z = self.slope * (logit - self.cuts[group]) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def windows(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` neighbouring rows side by side; x has width - 1 or more rows beyond the last window."""
    n = len(x) - max(WIDTHS) + 1
    return x[:n] if width == 1 else np.concatenate([x[i : i + n] for i in range(width)], axis=1)


def start_values(codes: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> ToxicityModel:
    """Embeddings that begin with the words' shrunken log odds of class 1, and filters of which one a width looks at these."""
    n = np.bincount(y, minlength=2)
    keys, tables = [], []
    for part in (lambda c: c >> BITS, lambda c: c & (ROWS - 1)):
        counts = np.zeros((2, ROWS))
        for c, k in zip(codes, y, strict=True):
            counts[k, np.unique(part(c))] += 1
        key = np.flatnonzero(counts.sum(axis=0) >= max(2, round(RARE * n[1])))
        p1, p0 = (counts[1, key] + 0.5) / (n[1] + 1), (counts[0, key] + 0.5) / (n[0] + 1)
        seen = counts[:, key].sum(axis=0)
        odds = np.log(p1 / p0) * seen / (seen + 4)
        table = rng.normal(0, 0.05, (len(key) + 1, DIM))
        table[0] = 0
        table[1:, 0] = np.clip(odds, -1, 4) / 2
        keys.append(key)
        tables.append(table)
    filters = [rng.normal(0, 0.3, (w * 2 * DIM, FILTERS)) for w in WIDTHS]
    for f, w in zip(filters, WIDTHS, strict=True):
        f[:, 0] = 0
        f[[0, DIM], 0] = 1.0
        f[np.arange(w) * 2 * DIM, 1] = f[np.arange(w) * 2 * DIM + DIM, 1] = 1.0 / w
    return ToxicityModel(tuple(keys), tuple(tables), filters, [np.full(FILTERS, -0.1) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.1), -0.5)


def train_filters(codes: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> ToxicityModel:
    """Stochastic gradient descent (Adagrad) on the logistic loss, text by text; classes weigh alike."""
    rng = np.random.default_rng(seed)
    m = start_values(codes, y, rng)
    places = m.dense()
    weight = (len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1)))[y]
    sq_tables = [np.full(t.shape, 1e-2) for t in m.tables]
    sq_f, sq_b = [np.full(f.shape, 1e-2) for f in m.filters], [np.full(FILTERS, 1e-2) for _ in WIDTHS]
    sq_out, sq_bias = np.full(len(m.out), 1e-2), 1e-2
    index = [(places[0][c >> BITS], places[1][c & (ROWS - 1)]) for c in codes]
    tail = np.zeros((max(WIDTHS), 2 * DIM))
    for _ in range(epochs):
        for i in rng.permutation(len(codes)):
            a, b = index[i]
            x = np.concatenate([np.concatenate([m.tables[0][a], m.tables[1][b]], axis=1), tail])
            h, where = m.pooled(x)
            p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.bias, -30, 30)))
            d = (p - y[i]) * weight[i]
            if abs(d) < 1e-3:
                continue
            dh = d * m.out * (h > 0)
            g = d * h + decay * m.out
            sq_out += g * g
            m.out -= rate * g / np.sqrt(sq_out)
            sq_bias += d * d
            m.bias -= rate * d / np.sqrt(sq_bias)
            for k, w in enumerate(WIDTHS):
                gh = dh[k * FILTERS : (k + 1) * FILTERS]
                if not gh.any():
                    continue
                span = where[k][:, None] + np.arange(w)  # filters x width
                seen = x[span].reshape(FILTERS, -1)
                gx = (m.filters[k] * gh).T.reshape(FILTERS * w, 2 * DIM)
                gf = seen.T * gh + decay * m.filters[k]
                sq_f[k] += gf * gf
                m.filters[k] -= rate * gf / np.sqrt(sq_f[k])
                sq_b[k] += gh * gh
                m.shift[k] -= rate * gh / np.sqrt(sq_b[k])
                at = span.ravel()
                inside = at < len(a)
                for t, idx in ((0, a), (1, b)):
                    rows, part = idx[at[inside]], gx[inside, t * DIM : (t + 1) * DIM]
                    np.add.at(sq_tables[t], rows, part * part)
                    np.add.at(m.tables[t], rows, -rate * part / np.sqrt(sq_tables[t][rows]))
                    m.tables[t][0] = 0
    return m


def logits(m: ToxicityModel, codes: list[np.ndarray]) -> np.ndarray:
    """Logits of texts, all at once: texts lie in a row with room between them."""
    places = m.dense() if not hasattr(m, "_places") else m._places
    m._places = places
    room = max(WIDTHS)
    n = np.array([len(c) + room for c in codes])
    first = np.cumsum(n) - n
    x = np.zeros((int(n.sum()) + room, 2 * DIM), np.float32)
    keep = np.ones(int(n.sum()), bool)
    for k in range(room):
        keep[first + n - 1 - k] = False
    x[: len(keep)][keep] = m.embed(np.concatenate([*codes, np.zeros(0, np.int64)]), places)
    out = np.full(len(codes), m.bias)
    for k, w in enumerate(WIDTHS):
        r = np.zeros((int(n.sum()), FILTERS), np.float32) + m.shift[k].astype(np.float32)
        for i in range(w):
            r += x[i : i + len(r)] @ m.filters[k][i * 2 * DIM : (i + 1) * 2 * DIM].astype(np.float32)
        for j in range(1, room):  # windows that would reach into the next text
            r[first + n - j] = 0
        out += np.maximum(np.maximum.reduceat(r, first, axis=0), 0) @ m.out[k * FILTERS : (k + 1) * FILTERS]
    return out


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts of least error, a false alarm (as a share of class 0) counting FALSE_COST misses."""
    order = np.argsort(logit, kind="stable")
    n0, n1 = np.maximum(np.bincount(y, minlength=2), 1)
    miss = np.concatenate([[0], np.cumsum(y[order] == 1)]) / n1
    false = 1 - np.concatenate([[0], np.cumsum(y[order] == 0)]) / n0
    error = miss + FALSE_COST * false
    at = np.flatnonzero(error <= error.min() + 1e-12)
    v = logit[order]
    edges = np.concatenate([[v[0] - 2], v, [v[-1] + 2]])
    i = max(at, key=lambda j: edges[j + 1] - edges[j])
    return float((edges[i] + edges[i + 1]) / 2)


def fit(codes: list[np.ndarray], y: np.ndarray) -> ToxicityModel:
    """Trains; cuts come from logits of texts held back in turn (two folds), for all texts and for each group with enough of both classes."""
    if len(set(y.tolist())) < 2:
        none = (np.zeros(0, np.int64),) * 2
        zero = (np.zeros((1, DIM)),) * 2
        flat = [np.zeros((w * 2 * DIM, FILTERS)) for w in WIDTHS]
        return ToxicityModel(none, zero, flat, [np.zeros(FILTERS) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), 5.0 if len(y) and y[0] else -5.0)
    m = train_filters(codes, y)
    back = np.zeros(len(y))
    half = np.arange(len(y)) % 2
    for part in (0, 1):
        use, rest = np.flatnonzero(half == part), np.flatnonzero(half != part)
        if len(set(y[use].tolist())) == 2:
            back[rest] = logits(train_filters([codes[i] for i in use], y[use]), [codes[i] for i in rest])
    m.groups = Groups.learn(codes)
    group = np.array([m.groups.of(c) for c in codes])
    m.cuts[:] = best_cut(back, y)
    for g in range(GROUPS):
        own = group == g
        if min((own & (y == k)).sum() for k in (0, 1)) >= 50:
            m.cuts[g] = best_cut(back[own], y[own])
    m.slope = 4.0 / max(0.5, float(np.std(back)))
    return m


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fits on at most per_class labelled texts of each class (crc32 of the id mod 3 not 1), which come to the driver as word hashes."""
    sample = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 3) != 1, per_class)

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        h = WordHashes()
        return {"w": pa.array([h.codes(words_of(t)).tobytes() for t in text_bytes(batch)], pa.binary())}

    rows = with_columns(sample, made, schema(w="binary"), ["doc_id", "y"]).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id * 2654435761 % 2**32, r.doc_id, bytes(r.w)))
    return fit([np.frombuffer(bytes(r.w), np.int64) for r in rows], np.array([r.y for r in rows], np.int64))


_hashes = WordHashes()


def detect(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score and predicted, of whole texts; null: as empty. Columns of the same names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the tables' rows

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = sent.value
        sole_memory("toxicity", _hashes.known.clear)
        codes = [_hashes.codes(words_of(t)) for t in text_bytes(batch)]
        score = m.score(logits(m, codes), np.array([m.groups.of(c) for c in codes], np.int64))
        return {"score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))}

    return with_columns(docs, made, schema(score="double", predicted="int"), keep)


def detect_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; labels of the held-out fold (crc32 of the id mod 3 is 1) are not read.

    Null ids are not held out but never learned from. Repeated rows stay; of several labels of an id the highest counts, and of its texts the
    least. Without labels no text is toxic. Texts of any length are read whole. An empty table gives an empty result.
    """
    model = train(docs, labels)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return detect(ids, model, ["doc_id"]).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
