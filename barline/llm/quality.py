"""Op 6: quality by histogram gradient-boosted trees over document statistics.

Statistics are shares of byte classes, words and lines of the whole text. The trees are fitted on binned statistics of a
bounded labelled sample, then laid out as flat arrays (one heap per tree), which executors walk for a whole batch of
documents at once in numpy.

Defined results: null counts as empty and empty texts get the score of all-zero statistics; repeated rows are scored
alike; rows with a null id are scored and count as held out. Without any usable label every document scores 1.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, field, held_out, labelled_sample, read

TRAIN_ROWS = 12_000
THRESHOLD = 0.7
DEPTH, TREES, BINS, RATE = 4, 80, 64, 0.12
CLASSES = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" \t\r\v\f", b"\n", b"#$%&*@^~=+_<>{}[]\\/", b"|", b"!?", b".,;:", b"()\"'`-", bytes(range(128, 256)), b"\x00\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x7f"]
SHOUT = re.compile(rb"\b[A-Z]{2,}\b")
TAIL = re.compile(rb"[#$%&*]{2,}(?:\s|$)")
NAMES = ["log_bytes", *(f"class_{i}" for i in range(len(CLASSES))), "log_words", "word_length", "distinct_words", "shouted", "symbol_tails", "log_lines", "line_length", "distinct_lines", "longest_line", "common_word", "sentence_length"]


def statistics(text: bytes | None) -> list[float]:
    """The values of NAMES for one text."""
    t = text or b""
    n = len(t)
    if not n:
        return [0.0] * len(NAMES)
    out = [np.log1p(n)] + [(n - len(t.translate(None, c))) / n for c in CLASSES]
    words = t.split()
    k = len(words)
    counts = Counter(words)
    lines = [x for x in t.split(b"\n") if x.strip()]
    longest = max(map(len, lines), default=0)
    common = max(counts.values(), default=0)
    ends = t.count(b".") + t.count(b"!") + t.count(b"?") + 1
    return out + [np.log1p(k), sum(map(len, words)) / max(k, 1), len(counts) / max(k, 1), len(SHOUT.findall(t)) / max(k, 1), len(TAIL.findall(t)) / max(k, 1), np.log1p(len(lines)), np.log1p(n / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), longest / n, common / max(k, 1), k / ends]


def fit_trees(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees for the log loss. Flat arrays: feature and cut of (tree, inner node), value of (tree, leaf), and the base logit."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    inner, width = (1 << DEPTH) - 1, x.shape[1]
    feature, cut, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    margin = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n = (1 << level) - 1, 1 << level
            at = node - first
            gain, where = np.full(n, 1e-3), np.full((n, 2), -1)
            for j in range(width):
                slot = at * BINS + binned[:, j]
                gl = np.cumsum(np.bincount(slot, weights=g, minlength=n * BINS).reshape(n, BINS), axis=1)
                hl = np.cumsum(np.bincount(slot, weights=h, minlength=n * BINS).reshape(n, BINS), axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                won = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                won[(hl < 2) | (ht - hl < 2)] = -1
                won[:, len(cuts[j]) :] = -1
                best = won.argmax(axis=1)
                better = won[np.arange(n), best] > gain
                gain[better], where[better] = won[np.arange(n), best][better], np.stack([np.full(n, j), best], axis=1)[better]
            for k in np.flatnonzero(where[:, 0] >= 0):
                feature[t, first + k], cut[t, first + k] = where[k, 0], cuts[where[k, 0]][where[k, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + 1)
        margin += value[t][leaf]
    return {"feature": feature, "cut": cut, "value": value, "base": base}


def walk(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of all rows of x at once: every tree's heap is descended level by level."""
    margin, rows, inner = np.full(len(x), model["base"]), np.arange(len(x)), model["feature"].shape[1]
    for feature, cut, value in zip(model["feature"], model["cut"], model["value"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        margin += value[node - inner]
    return 1 / (1 + np.exp(-margin))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", id_col: str = "doc_id") -> dict | None:
    """The trees, fitted on at most `rows` labelled documents (the documented bound of the sample); None without labels."""
    sample = labelled_sample(docs, labels, "quality", rows, text, id_col)
    got = append_columns(sample, "__text", lambda: lambda texts: {"x": [statistics(t) for t in texts]}, [field("x", "array<double>")], keep=["__y"]).collect()
    if not got:
        return None
    return fit_trees(np.array([r.x for r in got]), np.array([r["__y"] for r in got], float))


def score(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TREES heaps of fixed depth

    def make():
        def apply(texts):
            if shared.value is None:
                return {"score": np.ones(len(texts))}
            return {"score": walk(shared.value, np.array([statistics(t) for t in texts]))}

        return apply

    return append_columns(docs, text, make, [field("score", "double")], keep).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted good, with their own columns."""
    model = train(docs, read(spark, sf_dir, "labels"))
    own = docs.withColumns({f"__{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    scored = score(own, model, keep=[f"__{i}" for i in range(len(docs.columns))])
    return scored.where("predicted = 1").select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
