"""Op 1: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a logit, linear in hashed word features; the document's score is the
noisy-or of its sentences, 1 - prod(1 - p_s). Only documents have labels, so the weights are fitted on the bag's
likelihood; the sentence probabilities then say where the offence is.

Defined results: null and empty texts and texts without letters have no sentence and score 0; repeated rows each get
their own, equal row; rows with a null id are scored and count as held out; a column of the input with the name of a
result column is replaced; a text's score never falls when a sentence is added, so one of very many sentences can pass the
threshold by their number, as the noisy-or has it. Without any usable label (or with one class only) every weight is 0: no document is predicted.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, field, held_out, labelled_sample, read

BUCKETS = 1 << 20
TRAIN_ROWS = 5000
THRESHOLD = 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its first letters, where it is longer."""
    return (zlib.crc32(word.encode()) % BUCKETS, *(zlib.crc32(b"^" + word[:n].encode()) % BUCKETS for n in PREFIXES if len(word) > n))


def sentence_words(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of each sentence that has a word; offsets count characters."""
    found = ((m.start(), m.end(), set(WORD.findall(m[0].lower()))) for m in SENTENCE.finditer(text))
    return [x for x in found if x[2]]


#: Features whose gradient is computed at a time, which bounds the memory of the fit beyond the sample itself.
FIT_CHUNK = 1 << 19


def fit_noisy_or(bags: np.ndarray, rows: np.ndarray, features: np.ndarray, y: np.ndarray, rounds: int = 240, rate: float = 0.15, ridge: float = 6e-5, min_share: float = 0.003) -> tuple[np.ndarray, float]:
    """Weights and bias that fit the bag labels y. rows: the sentence of each feature, ascending; bags: the bag of each sentence, ascending.

    Features of fewer than two bags, or of a smaller share than min_share, get no weight: they would learn single documents by heart.
    """
    counts = np.zeros(BUCKETS, np.int32)
    edges = np.searchsorted(bags[rows], np.arange(len(y) + 1)) if len(rows) else np.zeros(len(y) + 1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        counts[np.unique(features[a:b])] += 1
    seen = counts >= max(2, min_share * len(y))
    known = seen[features]
    rows, features = rows[known].astype(np.int32), (np.cumsum(seen, dtype=np.int32) - 1)[features[known]]
    used = np.flatnonzero(seen)
    del known, seen, counts
    w, b, n = np.zeros(len(used) + 1), -4.0, len(bags)
    m, v = np.zeros_like(w), np.zeros_like(w)
    positive = y[bags] == 1
    chunks = [slice(k, k + FIT_CHUNK) for k in range(0, len(rows), FIT_CHUNK)]
    for step in range(1, rounds + 1):
        z = np.full(n, b)
        for c in chunks:
            z += np.bincount(rows[c], weights=w[features[c]], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.bincount(bags, weights=np.logaddexp(0, z), minlength=len(y))
        share = np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9)
        g_z = np.where(positive, -p * share[bags], p) / len(y)
        g = np.append(ridge * w[:-1], g_z.sum())
        for c in chunks:
            g[:-1] += np.bincount(features[c], weights=g_z[rows[c]], minlength=len(used))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] -= move[:-1]
        b -= move[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w[:-1]
    return weights, float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", id_col: str = "doc_id") -> tuple[np.ndarray, float]:
    """Weights and bias, fitted on at most `rows` labelled documents (the documented bound of the sample)."""
    sample = labelled_sample(docs, labels, "toxic", rows, text, id_col)

    def make():
        def features(texts):
            out = []
            for t in texts:
                sentences = [sorted({f for w in words for f in word_features(w)}) for _, _, words in sentence_words((t or b"").decode())]
                out.append((len(sentences), np.array([len(s) for s in sentences], "<i4").tobytes(), np.array([f for s in sentences for f in s], "<i4").tobytes()))
            return dict(zip(("n", "sizes", "features"), zip(*out), strict=True))

        return features

    found = append_columns(sample, "__text", make, [field("n", "int"), field("sizes", "binary"), field("features", "binary")], keep=["__y"])
    got = found.where("n > 0").toArrow()  # `rows` documents at most, 4 bytes a feature; columns, not row objects
    y = got.column("__y").to_numpy().astype(np.int8)
    if len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), -30.0
    sizes, features = (np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in got.column(c)]) for c in ("sizes", "features"))
    bags = np.repeat(np.arange(len(y), dtype=np.int32), got.column("n").to_numpy())
    del got
    return fit_noisy_or(bags, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), features, y)


class _Weights(dict):
    """Word -> summed weight of its features; forgets all when it has grown too large."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = float(sum(self.weights[f] for f in word_features(word)))
        return value


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """docs with score, predicted and, if spans, the offending sentences: structs of start, end (characters) and probability."""
    shared, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]  # BUCKETS floats, 4 MB

    def make():
        weight = _Weights(shared.value)

        def apply(texts):
            scores, found = [], []
            for t in texts:
                z, at = [], []
                if t:
                    for a, b, words in sentence_words(t.decode()):
                        z.append(sum(map(weight.__getitem__, words)) + bias)
                        at.append((a, b))
                p = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
                scores.append(float(-np.expm1(np.log1p(-p).sum())) if z else 0.0)
                if spans:
                    found.append([{"start": at[i][0], "end": at[i][1], "probability": float(p[i])} for i in np.flatnonzero(p >= THRESHOLD)])
            return {"score": scores, "offending": found}

        return apply

    fields = [field("score", "double")] + [field("offending", "array<struct<start: bigint, end: bigint, probability: double>>")] * spans
    scored = append_columns(docs, text, make, fields, keep)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted, and how many sentences offend."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, with their own columns."""
    model = train(docs, read(spark, sf_dir, "labels"))
    scored = score(docs.withColumns({f"__{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}), model, keep=[f"__{i}" for i in range(len(docs.columns))], spans=False)
    return scored.where("predicted = 0").select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
