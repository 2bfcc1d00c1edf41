import random
import zlib

import corpus_pipeline
from barline.llm import jaccard, unigram

INSULTS = ["scumbag", "moronic", "worthlesss"]


def make(seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice(["ba", "ko", "ti", "ru", "sen", "lo", "mi"]) for _ in range(r.randint(1, 4))) for _ in range(800)]
    text = lambda n: ". ".join(" ".join(r.choice(vocab) for _ in range(10)).capitalize() for _ in range(n // 10)) + "."
    item = " ".join(r.choice(vocab) for _ in range(20))
    docs, kind = [], {}
    for k in range(600):
        t = text(r.randrange(40, 200))
        what = "good"
        if k % 7 == 1:
            t, what = t + " You " + r.choice(INSULTS) + " and " + r.choice(INSULTS) + ". " + text(20), "toxic"
        elif k % 7 == 2:
            t, what = " ".join(w + r.choice(["%%%", "$$$", "***"]) for w in t.split()), "junk"
        elif k % 50 == 3:
            t, what = " ".join(t.split()[:40]) + " " + item + " end", "leak"
        elif k % 50 == 4:
            t, what = docs[-1][1] if kind[k - 1] == "good" else t, "copy" if kind[k - 1] == "good" else "good"
        docs.append((k, t, "en", f"s{k % 3}", len(t)))
        kind[k] = what
    labels = [(k, int(kind[k] != "junk"), int(kind[k] == "toxic")) for k in range(600) if k % 4]
    return docs, labels, [(1, item)], kind


def test_pipeline(spark, tmp_path):
    docs, labels, items, kind = make()
    docs += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0)]
    spark.createDataFrame([(*d, 1.5) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = now.columns
        now = corpus_pipeline.common.staged(stage(spark, now, str(tmp_path)), name)
        assert now.columns == columns
        left[name] = {r.doc_id for r in now.collect()}
    of = lambda what: {k for k, v in kind.items() if v == what}
    good = of("good")
    assert not left["toxicity"] & of("toxic") and len(good & left["toxicity"]) >= 0.99 * len(good)
    assert not left["quality"] & of("junk") and len(good & left["quality"]) >= 0.98 * len(good)
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 1000")).collect()}
    assert left["near_duplicates"] == {d for d in left["quality"] if d >= 1000 or d == min(e for e in left["quality"] if e < 1000 and found[e] == found[d])}
    assert left["decontamination"] == left["near_duplicates"] - of("leak")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {d[0]: d[1] or "" for d in docs}
    assert {r.doc_id for r in rows} == left["decontamination"]
    vocab = unigram.vocabulary(unigram.model_path())
    assert all(unigram.decode(vocab, r.ids) == texts[r.doc_id] and r.decoded_equal and len(r.ids) == r.n_tokens for r in rows)


def test_learning_leaves_the_held_out_quarter_alone(spark):
    from barline.llm.common import labelled_sample

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(400)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 400, 2)] + [(1, 0), (1, 1), (3, 7), (5, None), (None, 1)], "doc_id long, toxic int")
    got = {r["__text"] for r in labelled_sample(docs, labels, "toxic", 1000).collect()}
    assert got == {f"text {k}" for k in range(0, 400, 2) if zlib.crc32(str(k).encode()) % 4 != 2}
    assert labelled_sample(docs, labels, "toxic", 10).count() == 10


def test_empty_tables_and_null_ids(spark, tmp_path):
    """No documents, then two documents without an id, with nothing to learn from and no benchmark."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, rows in (("none", []), ("some", [(None, "a text without an id", "en", "s", 20), (None, None, None, None, None)])):
        (tmp_path / name).mkdir()
        for t in ("labels", "benchmark"):
            (tmp_path / name / f"{t}.parquet").symlink_to(tmp_path / f"{t}.parquet")
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert "ids" in out.columns and out.count() <= len(rows)


def test_sentencepiece_stage_keeps_all_documents(spark, tmp_path):
    """The last stage: every row has its ids, which decode to its text; null texts are empty, clashing columns are replaced."""
    rows = [(1, "hello world", "x"), (2, None, "y"), (None, "no id ☃", "z"), (3, "a" * 30_000, "w"), (1, "hello world", "x")]
    out = unigram.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), str(tmp_path))
    vocab = unigram.vocabulary(unigram.model_path())
    got = sorted((r.doc_id or 0, unigram.decode(vocab, r.ids)) for r in out.collect())
    assert got == sorted((d or 0, t or "") for d, t, _ in rows)
