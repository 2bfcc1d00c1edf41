"""Op 6: statistics, trees and their walk against brute force, and the query's edge cases."""

import math
import zlib

import numpy as np
import pytest

from barline.llm import common, quality

SCHEMA = "doc_id long, text string, lang string, score string, predicted string"


def test_common_word_is_of_the_whole_text():
    share = lambda words: quality.statistics(" ".join(words).encode())[quality.NAMES.index("common_word")]
    words = [f"w{k}" for k in range(800)]
    for k in range(1, 800, 3):
        if k % 100:
            words[k] = "spam"
    n = words.count("spam")
    assert share(words) == n / 800
    assert share(["front", *words]) == n / 801
    assert share([]) == 0.0 and share(["one"]) == 1.0


def brute_walk(model, x):
    """One row through one tree after the other, node by node."""
    margin = model["base"]
    for feature, cut, value in zip(model["feature"], model["cut"], model["value"], strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        margin += value[node - len(feature)]
    return 1 / (1 + math.exp(-margin))


def corpus(n=300):
    """Good documents are sentences; bad ones are marks and shouting."""
    r = np.random.default_rng(8)
    words = "the a river house walks slowly under grey light and sings of old days".split()
    docs, labels = [], []
    for k in range(n):
        good = int(r.random() < 0.6)
        text = " ".join(words[i] for i in r.integers(0, len(words), 40)) + "." if good else " ".join("#$%&" if r.random() < 0.5 else words[i].upper() for i in r.integers(0, len(words), 25))
        docs.append((k, text, "en", "x", "y"))
        labels.append((k, good, 0))
    return docs, labels


def test_walk_equals_brute_force():
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(600, 6)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit_trees(x, y)
    rows = np.concatenate([x[:80], [c for c in np.where(np.isfinite(model["cut"][0][:6]), model["cut"][0][:6], 0)[None, :]]])
    assert np.allclose(quality.walk(model, rows), [brute_walk(model, v) for v in rows])
    assert ((quality.walk(model, x) >= 0.5) == y).mean() > 0.95


def test_first_split_is_the_best_of_all():
    """The first tree's root takes the feature and cut of the greatest gain over every bin of every feature."""
    r = np.random.default_rng(4)
    x = r.integers(0, 9, size=(200, 4)).astype(float)
    y = (x[:, 2] >= 5).astype(float)
    y[:10] = 1 - y[:10]
    model = quality.fit_trees(x, y)
    p = 1 / (1 + math.exp(-model["base"]))
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(j, c):
        left = x[:, j] <= c
        parts = [(g[s].sum(), h[s].sum()) for s in (left, ~left)]
        return -1 if min(b for _, b in parts) < 2 else sum(a * a / (b + 1) for a, b in parts) - g.sum() ** 2 / (h.sum() + 1)

    best = max(gain(j, c) for j in range(4) for c in range(9))
    assert gain(model["feature"][0][0], model["cut"][0][0]) == pytest.approx(best)


def test_query_equals_the_definition(spark, tmp_path, monkeypatch):
    docs, labels = corpus()
    odd = [(1000, None, None, None, None), (1001, "", "", "", ""), (None, docs[0][1], "", "", ""), (1002, "#$%& " * 200_000, "", "", ""), (1003, docs[1][1] * 5000, "", "", ""), (4, docs[4][1], "", "", ""), (1004, " \n\t", "", "", "")]
    labels += [(1000, None, None), (1001, 5, 0), (None, 0, 1), (9, labels[9][1], 0), (11, 1 - labels[11][1], 0)]
    spark.createDataFrame(docs + odd, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    made = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    monkeypatch.setattr(quality, "train", lambda *a, **k: made)
    got = sorted(map(tuple, quality.op6_quality(spark, str(tmp_path)).collect()), key=str)
    want = []
    for d, text, *_ in docs + odd:
        s = brute_walk(made, quality.statistics(None if text is None else text.encode()))
        want.append((d, d is None or zlib.crc32(str(d).encode()) % 4 == 2, s, int(s >= 0.7)))
    want.sort(key=str)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    by_id = {g[0]: g for g in got}
    assert by_id[1000][2] == by_id[1001][2] and by_id[1002][3] == 0
    truth = {d: q for d, q, _ in labels[: len(docs)]}
    out = [(g[3], truth[g[0]]) for g in got if g[1] and g[0] in truth]
    assert len(out) > 40 and sum(p == t for p, t in out) >= 0.95 * len(out)


def test_threshold_is_reached_at_equality(spark):
    """With trees of zeros the base alone decides: 0.7 is predicted, less is not."""
    inner = (1 << quality.DEPTH) - 1
    one = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    for base, want in ((math.log(0.7 / 0.3) + 1e-9, 1), (math.log(0.7 / 0.3) - 1e-9, 0)):
        model = {"feature": np.zeros((1, inner), int), "cut": np.full((1, inner), np.inf), "value": np.zeros((1, inner + 1)), "base": base}
        assert quality.score(one, model).first().predicted == want


@pytest.mark.parametrize("kind", ["empty", "no labels", "one class"])
def test_nothing_to_learn(spark, tmp_path, kind):
    docs, labels = corpus(40)
    docs, labels = ([], []) if kind == "empty" else (docs, []) if kind == "no labels" else (docs, [(d, 1, t) for d, _, t in labels])
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op6_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(r.predicted == 1 for r in got)
    kept = quality.stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns == ["doc_id", "text", "lang", "score", "predicted"] and kept.count() == len(docs)


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    """However often a labelled doc_id is repeated, its sample holds it once: the text of the smallest hash."""
    docs = spark.range(5000).selectExpr("id % 3 as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(k, 1) for k in range(3)], "doc_id long, quality int")
    known = sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(3))
    got = common.labelled_sample(docs, labels, "quality", 10)
    assert got.count() == known > 0 and got.collect() == got.collect()
