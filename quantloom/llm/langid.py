"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (of several lengths: a blended spectrum) present in both, by the geometric mean
of the numbers present in each. N-grams are hashed. Landmarks among the training texts give Nyström features, on which one ridge
regression a language (against the rest) is solved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, schema, text_bytes, with_columns

#: Lengths of the n-grams, in bytes of the lower-cased UTF-8 text.
SPECTRUM = (1, 2, 3, 4)
#: Hashed n-grams of all lengths.
BITS = 14
BUCKETS = 1 << BITS
#: Training texts of each language at most, those with the least hash of their id; of these, landmarks.
PER_LANGUAGE = 400
LANDMARKS_EACH = 24
#: Landmarks of all languages together.
MOST_LANDMARKS = 1536
RIDGE = 1e-3
#: Texts of one matrix product.
ROWS = 128
#: Characters of a text that its n-grams are gathered from at a time.
PIECE = 1 << 18


def letters_only(text: str) -> bytes:
    """The text's words of letters, in lower case, each between blanks; as UTF-8."""
    low = text.lower()
    if not low.isascii():
        table = {ord(c): " " for c in set(low) if not c.isalpha()}
        low = low.translate(table)
        return b" " + b" ".join(low.encode().split()) + b" "
    return b" " + b" ".join(low.encode().translate(_ASCII).split()) + b" "


_ASCII = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def presence(clean: bytes, into: np.ndarray) -> None:
    """Sets into[b] to 1 for each bucket b of an n-gram of the cleaned text. `into` is zero at first."""
    for at in range(0, len(clean), PIECE):
        x = np.frombuffer(clean[at : at + PIECE + max(SPECTRUM) - 1], np.uint8).astype(np.uint32)
        h = np.zeros(len(x), np.uint32)
        for n in range(1, max(SPECTRUM) + 1):
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] * np.uint32(0x01000193)) ^ (x[n - 1 :] + np.uint32(1))
            if n in SPECTRUM:
                g = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
                into[g >> np.uint32(32 - BITS)] = 1


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalized presence kernel of the rows of x with the landmarks."""
    nx, nl = np.maximum(x.sum(axis=1), 1), np.maximum(landmarks.sum(axis=1), 1)
    return (x @ landmarks.T) / np.sqrt(nx[:, None] * nl[None, :])


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x buckets, 0 or 1
    project: np.ndarray  # landmarks x landmarks: K_mm ^ -1/2
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def decide(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.landmarks) @ self.project @ self.weights + self.bias


def fit(x: np.ndarray, langs: list[str], landmarks_each: int = LANDMARKS_EACH, ridge: float = RIDGE) -> LanguageModel:
    """Fits on rows of presence (0 or 1). Landmarks: the first of each language in the order given."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    y = np.array([names.index(v) for v in langs])
    marks = x[np.concatenate([np.flatnonzero(y == k)[:landmarks_each] for k in range(len(names))])]
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = value > 1e-6 * value.max()
    project = (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T
    phi = kernel(x, marks) @ project
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    # classes weigh alike, whatever their numbers
    w = (1 / np.maximum(np.bincount(y, minlength=len(names)), 1))[y]
    w /= w.sum()
    mean, centre = w @ phi, w @ target
    a = (phi - mean) * w[:, None]
    weights = np.linalg.solve(a.T @ (phi - mean) + ridge * np.eye(phi.shape[1]) / len(names), a.T @ (target - centre))
    return LanguageModel(names, marks, project, weights, centre - mean @ weights)


def train(docs: DataFrame, n_folds: int = 5, held_out: int = 0, per_language: int = PER_LANGUAGE, landmarks_each: int = LANDMARKS_EACH) -> LanguageModel:
    """Fits on at most per_language texts of each non-null lang value outside the held-out fold: all values are learned.

    The sample is bounded by these parameters; its texts come to the driver as presence bits of BUCKETS. Beyond MOST_LANDMARKS / landmarks_each
    values, each has fewer landmarks and texts, so that the model keeps its size. Of rows that repeat an id the least text is taken.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), n_folds) != held_out))
    values = known.agg(F.count_distinct("lang")).first()[0]
    share = min(1.0, MOST_LANDMARKS / (landmarks_each * max(1, values)))
    landmarks_each, per_language = max(1, int(landmarks_each * share)), max(1, int(per_language * share))
    # ranks up to a bound, first in parts of a language: a language with very many texts isn't gathered
    part = F.pmod(F.xxhash64("h"), F.lit(32))
    some = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("part", part)
    for by in (["lang", "part"], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
        some = some.withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth")
    # at most per_language ids of each value
    sample = docs.select("doc_id", "lang", "text").where("text IS NOT NULL").join(F.broadcast(some.drop("part").distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text"))

    def bits(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = []
        for c in map(clean_bytes, text_bytes(batch)):
            x = np.zeros(BUCKETS, np.float32)
            presence(c, x)
            rows.append(np.packbits(x > 0).tobytes())
        return {"bits": pa.array(rows, pa.binary())}

    rows = sorted((r.h, r.doc_id, r.lang, bytes(r.bits)) for r in with_columns(sample, bits, schema(bits="binary"), ["doc_id", "lang", "h"]).collect())
    if not rows:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    x = np.unpackbits(np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    return fit(x, [r[2] for r in rows], landmarks_each)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred and score, of whole texts.

    lang_pred: `und` with score 0 if the text is null or has no letter, or if no language was learned. score: half of one plus the
    winner's decision, between 0 and 1. Ties go to the language that comes first by name. Columns of the same names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS_EACH rows a language

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = sent.value
        names, scores = [], []
        cleaned = [clean_bytes(t) for t in text_bytes(batch)]
        for at in range(0, len(cleaned), ROWS):
            part = cleaned[at : at + ROWS]
            if not m.languages:
                names += ["und"] * len(part)
                scores += [0.0] * len(part)
                continue
            x = np.zeros((len(part), BUCKETS), np.float32)
            for row, c in zip(x, part, strict=True):
                if c.strip():
                    presence(c, row)
            d = m.decide(x)
            best = d.argmax(axis=1)
            top = np.clip((d[np.arange(len(part)), best] + 1) / 2, 0, 1)
            blank = [not c.strip() for c in part]
            names += ["und" if b else m.languages[k] for b, k in zip(blank, best, strict=True)]
            scores += [0.0 if b else float(v) for b, v in zip(blank, top, strict=True)]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return with_columns(docs, made, schema(lang_pred="string", score="double"), keep)


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document: learned from the folds that are not held out (crc32 of the id mod 5 is not 0).

    Null ids are in the held-out fold and are never learned from. Repeated rows stay; an empty table gives an empty result. Texts of any
    length are read whole, PIECE characters at a time.
    """
    model = train(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return identify(ids, model, ["doc_id"]).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def clean_bytes(text: bytes) -> bytes:
    return letters_only(text.decode())
