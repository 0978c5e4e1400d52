"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge loss solved by dual coordinate descent."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, schema, text_bytes, with_columns

#: Buckets of hashed byte n-grams; behind them LEVELS indicators of each word statistic.
BITS = 16
BUCKETS = 1 << BITS
LEVELS = 12
WIDTH = BUCKETS + 3 * LEVELS
#: Lengths of byte n-grams.
GRAMS = (1, 2, 3, 4)
#: Training texts of each class at most, those with the least hash of their id.
PER_CLASS = 2500
#: Bytes of a text whose n-grams are hashed at a time.
PIECE = 1 << 18
#: predicted is score >= THRESHOLD.
THRESHOLD = 0.3


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The buckets of the text's features, each once. seen: a zeroed scratch array of WIDTH bytes, zeroed again on return."""
    for at in range(0, len(text), PIECE):
        x = np.frombuffer(text[at : at + PIECE + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        h = np.zeros(len(x), np.uint32)
        for n in GRAMS:
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] * np.uint32(0x01000193)) ^ (x[n - 1 :] + np.uint32(1))
            seen[((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = 1
    words = text.split()
    if words:
        # word bigrams of a word with itself, share of distinct words, and length: as indicators of levels
        same = sum(map(eq, words, words[1:]))
        distinct = len(set(words)) / len(words)
        for k, v in enumerate((same * LEVELS // len(words), int(distinct * LEVELS), len(words).bit_length() - 1)):
            seen[BUCKETS + k * LEVELS + min(v, LEVELS - 1)] = 1
    found = np.flatnonzero(seen)
    seen[found] = 0
    return found


@dataclass
class QualityModel:
    weights: np.ndarray  # of each feature, log-count ratio included
    bias: float
    slope: float
    cut: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() / np.sqrt(max(1, len(r))) + self.bias for r in rows])

    def score(self, margin: np.ndarray) -> np.ndarray:
        """The margin as a probability-like value that is THRESHOLD at the cut."""
        z = self.slope * (margin - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log of the ratio of the features' smoothed shares in class 1 and class 0."""
    counts = [np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == c] or [np.zeros(0, np.int64)]), minlength=WIDTH) + alpha for c in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights (over scaled features) and bias of the L1-loss linear support vector machine, by dual coordinate descent.

    Each coordinate is the multiplier of one text, kept between 0 and its class's cost; classes weigh alike.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    upper = cost * len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))[y]
    values = [scale[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([v @ v + 1.0 for v in values])  # 1: the bias as a constant feature
    w, b, a = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            g = sign[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(a[i] - g / norm[i], 0.0), upper[i])
            step = (new - a[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                b += step
                a[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, b


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 30) -> QualityModel:
    """Fits, and sets the cut where held-back margins (two folds) are split with the least balanced error."""
    if len(set(y.tolist())) < 2:
        # one class or none: a constant, above or below the threshold
        return QualityModel(np.zeros(WIDTH), 1.0 if not len(y) or y[0] == 1 else -1.0, 2.0, 0.0)
    back = np.zeros(len(y))
    for part in (0, 1):
        use, rest = [np.flatnonzero(np.arange(len(y)) % 2 == k) for k in (part, 1 - part)]
        own = [rows[i] for i in use]
        if len(set(y[use].tolist())) < 2:
            continue
        r = ratios(own, y[use])
        w, b = dual_descent(own, y[use], r, cost, epochs)
        back[rest] = QualityModel(w * r, b, 1.0, 0.0).margins([rows[i] for i in rest])
    r = ratios(rows, y)
    w, b = dual_descent(rows, y, r, cost, epochs)
    order = np.argsort(back, kind="stable")
    # error of a cut below each place: class 1 under it, class 0 over it
    n0, n1 = np.bincount(y, minlength=2)
    under = np.concatenate([[0], np.cumsum(y[order] == 1)]) / n1
    over = 1 - np.concatenate([[0], np.cumsum(y[order] == 0)]) / n0
    at = np.flatnonzero(under + over <= (under + over).min() + 1e-12)
    edges = np.concatenate([[back[order[0]] - 1], back[order], [back[order[-1]] + 1]])
    cut = float(np.mean([(edges[i] + edges[i + 1]) / 2 for i in at]))
    spread = float(np.std(back)) or 1.0
    return QualityModel(w * r, b, 4.0 / spread, cut)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Fits on at most per_class labelled texts of each class (crc32 of the id mod 5 not 0), which come to the driver as feature sets."""
    sample = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, per_class)

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        seen = np.zeros(WIDTH, np.uint8)
        return {"f": pa.array([features(t, seen).astype("<u4").tobytes() for t in text_bytes(batch)], pa.binary())}

    rows = with_columns(sample, made, schema(f="binary"), ["doc_id", "y"]).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id * 2654435761 % 2**32, r.doc_id, bytes(r.f)))
    return fit([np.frombuffer(bytes(r.f), "<u4").astype(np.int64) for r in rows], np.array([r.y for r in rows], np.int64))


def rate(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score and predicted, of whole texts; null: as empty. Columns of the same names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = sent.value
        seen = np.zeros(WIDTH, np.uint8)
        score = m.score(m.margins([features(t, seen) for t in text_bytes(batch)]))
        return {"score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))}

    return with_columns(docs, made, schema(score="double", predicted="int"), keep)


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; labels of the held-out fold (crc32 of the id mod 5 is 0) are not read.

    Null ids are in the held-out fold. Repeated rows stay; of several labels of an id the highest counts, and of its texts the least. Without
    labels every text gets one score, above the threshold. Texts of any length are read whole. An empty table gives an empty result.
    """
    model = train(docs, labels)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rate(ids, model, ["doc_id"]).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
