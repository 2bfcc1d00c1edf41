"""Op 1: the noisy-or against its definition, its fit against a plain gradient, offending sentences, and the query's edge cases."""

import math
import re
import zlib

import numpy as np
import pytest

from barline.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score string, predicted string"


def brute_score(model, text):
    """The noisy-or of the sentences, word by word, by the definition."""
    weights, bias = model
    keep = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = set(re.findall(r"[^\W\d_]+", sentence.lower()))
        if words:
            z = bias
            for w in words:
                keys = [w.encode()] + [b"^" + w[:n].encode() for n in (4, 5, 6) if len(w) > n]
                z += sum(float(weights[zlib.crc32(k) % toxicity.BUCKETS]) for k in keys)
            keep *= 1 - 1 / (1 + math.exp(-z))
    return 1 - keep


def corpus(n=240):
    """Toxic documents hold one sentence with a bad word among clean ones."""
    r = np.random.default_rng(3)
    clean = ["the garden is green", "we walk home today", "books are on the table", "rain falls in spring", "a train leaves early"]
    bad = ["you are a grumblefink", "what a snarkwaddle that is"]
    docs, labels = [], []
    for k in range(n):
        toxic = int(r.random() < 0.3)
        lines = [clean[i] for i in r.integers(0, len(clean), 4)]
        if toxic:
            lines[int(r.integers(0, 4))] = bad[int(r.integers(0, 2))]
        docs.append((k, ". ".join(lines), "en", "x", "y"))
        labels.append((k, 1, toxic))
    return docs, labels


def test_gradient_of_one_step_is_that_of_the_likelihood():
    """After one Adam step from zero each weight moves against the sign of the numerical derivative of the bags' likelihood."""
    bags, rows, features, y = np.array([0, 0, 1, 2]), np.array([0, 1, 1, 2, 3]), np.array([5, 5, 9, 9, 5]), np.array([1, 0, 0], np.int8)

    def loss(w5, w9):
        z = np.array([w5, w5 + w9, w9, w5]) - 4.0
        q = [np.prod([1 - 1 / (1 + math.exp(-z[i])) for i in np.flatnonzero(bags == k)]) for k in range(3)]
        return -sum(math.log(1 - q[k]) if y[k] else math.log(q[k]) for k in range(3)) / 3

    slope = {5: (loss(1e-5, 0) - loss(-1e-5, 0)) / 2e-5, 9: (loss(0, 1e-5) - loss(0, -1e-5)) / 2e-5}
    w, _ = toxicity.fit_noisy_or(bags, rows, features, y, rounds=1, rate=0.1, min_share=0)
    for k, s in slope.items():
        assert w[k] == pytest.approx(-0.1 * np.sign(s), rel=1e-3)


def test_chunks_change_nothing(monkeypatch):
    r = np.random.default_rng(0)
    bags = np.sort(r.integers(0, 30, 100))
    rows, features, y = np.sort(r.integers(0, 100, 700)), r.integers(0, 40, 700), r.integers(0, 2, 30).astype(np.int8)
    whole = toxicity.fit_noisy_or(bags, rows, features, y, rounds=20)
    monkeypatch.setattr(toxicity, "FIT_CHUNK", 13)
    parts = toxicity.fit_noisy_or(bags, rows, features, y, rounds=20)
    assert np.allclose(whole[0], parts[0], atol=1e-5) and whole[1] == pytest.approx(parts[1])


def test_query_equals_the_definition(spark, tmp_path, monkeypatch):
    """Scores of all rows equal a brute-force noisy-or; held-out toxic documents are found; odd rows have their defined results."""
    docs, labels = corpus()
    long_text = "the garden is green. " * 50_000
    odd = [(1000, None, None, None, None), (1001, "", "", "", ""), (1002, " .\n!? 123 __", "en", "", ""), (None, "you are a grumblefink", "en", "", ""), (1003, long_text, "en", "", ""), (1004, long_text + "What a SNARKWADDLE that is", "en", "", ""), (5, docs[5][1], "en", "", ""), (5, "you are a grumblefink", "en", "", "")]
    labels += [(1000, None, None), (1001, 0, 7), (None, 0, 1), (7, 0, 1 - labels[7][2]), (9, 1, labels[9][2])]
    spark.createDataFrame(docs + odd, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    made = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: made)
    got = sorted(map(tuple, toxicity.op1_toxicity(spark, str(tmp_path)).select("doc_id", "held_out", "score", "predicted").collect()), key=str)
    want = []
    for d, text, *_ in docs + odd:
        s = brute_score(made, text)
        want.append((d, d is None or zlib.crc32(str(d).encode()) % 4 == 2, s, int(s >= 0.3)))
    want.sort(key=str)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-5)
    by_id = {g[0]: g for g in got}
    assert by_id[1000][2:] == by_id[1001][2:] == by_id[1002][2:] == (0.0, 0) and by_id[1004][3] == 1
    truth = {d: t for d, _, t in labels[: len(docs)]}
    out = [(g[3], truth[g[0]]) for g in got if g[1] and g[0] in truth]
    assert len(out) > 30 and sum(p == t for p, t in out) >= 0.95 * len(out)


def test_offending_sentences_are_located(spark, tmp_path):
    docs, labels = corpus()
    table = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = "The garden is green. You are a grumblefink! Rain falls"
    [row] = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert row.predicted == 1 and [text[x.start : x.end].strip() for x in row.offending] == ["You are a grumblefink"]


def test_threshold_is_reached_at_equality(spark):
    """A score of exactly 0.3 is predicted, the next smaller double is not."""
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    one = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    bias = math.log(0.3 / 0.7)
    s = toxicity.score(one, (weights, bias)).first()
    assert s.predicted == int(s.score >= 0.3)
    assert toxicity.score(one, (weights, bias + 1e-6)).first().predicted == 1 and toxicity.score(one, (weights, bias - 1e-6)).first().predicted == 0


@pytest.mark.parametrize("kind", ["empty", "no labels", "one class"])
def test_nothing_to_learn(spark, tmp_path, kind):
    docs, labels = corpus(40)
    docs, labels = ([], []) if kind == "empty" else (docs, []) if kind == "no labels" else (docs, [(d, q, 1) for d, q, _ in labels])
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op1_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(r.predicted == 0 for r in got)
    kept = toxicity.stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns == ["doc_id", "text", "lang", "score", "predicted"] and kept.count() == len(docs)
