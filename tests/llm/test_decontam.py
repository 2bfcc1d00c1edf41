import hashlib
import re
import zlib

import pytest

from barline.llm import decontam

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    words = WORDS.findall((text or "").encode().lower())
    hit, found = set(), set()
    for i, t in items:
        own = WORDS.findall((t or "").encode().lower())
        for k in range(max(1, len(own) - 12) if own else 0):
            w = own[k : k + 13]
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    hit |= set(range(p, p + len(w)))
                    found.add(str(i))
    return len(words), len(hit), sorted(found)


def vocabulary(n, seed):
    return [f"w{zlib.crc32(f'{seed}-{k}'.encode()) % 40}" for k in range(n)]


@pytest.fixture
def tables():
    items = [(1, " ".join(vocabulary(30, "a"))), (2, "Só curto"), (3, ""), (4, None), (5, "x"), (11, " ".join(vocabulary(30, "a"))), (6, " ".join(vocabulary(13, "b")))]
    a = vocabulary(30, "a")
    docs = [(1, "x, y"), (2, None), (3, ""), (4, "!!"), (5, " ".join(vocabulary(50, "c") + a[3:20] + vocabulary(20, "d"))), (5, "só CURTO só curto"), (6, "X" * 20), (7, "\n".join(a).upper()),
            (8, " ".join(vocabulary(5000, "e") + a + vocabulary(5000, "f") + vocabulary(13, "b"))), (9, "... ".join(vocabulary(13, "b"))), (10, " ".join(a[:12]))]
    return docs, items


def test_matches_brute_force(spark, tmp_path, tables):
    docs, items = tables
    spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, n_words string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.op9_decontamination(spark, str(tmp_path)).collect())
    want = []
    for d, t in docs:
        n, h, found = brute(t, items)
        want.append((d, n, h, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), h > 0 and 20 * h >= n))
    assert got == sorted(want)


def test_blocks_give_the_same(spark, tables, monkeypatch):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontam.find_hits(d, b, keep=["doc_id"]).select("doc_id", "n_words", "items", F_sorted("hit_words")).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)
    n, blocks = decontam.blocks_of_items(b)
    assert n > 2 and len(list(blocks)) == n
    assert sorted(map(str, decontam.find_hits(d, b, keep=["doc_id"]).select("doc_id", "n_words", "items", F_sorted("hit_words")).collect())) == whole


def F_sorted(c):
    from pyspark.sql import functions as F

    return F.array_sort(c).alias(c)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_hits(d, b).count() == 0
    one = decontam.find_hits(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), b, keep=["doc_id"]).first()
    assert (one.n_words, one.hit_words, one["items"]) == (2, [], [])


def test_texts_beyond_a_slice_and_many_items_of_one_window(spark, monkeypatch):
    """A text of several slices is searched whole, and a window that thousands of items share names them all."""
    from barline.llm import common

    monkeypatch.setattr(common, "CHUNK_BYTES", 4096)
    passage = " ".join(vocabulary(13, "p"))
    text = " ".join(vocabulary(4000, "q")) + " " + passage + " tail"
    items = [(k, passage) for k in range(3000)] + [(9000, "tail")]
    d = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.find_hits(d, spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id"]).collect()}
    assert got[1]["items"] == sorted(str(i) for i, _ in items) and sorted(got[1].hit_words) == list(range(4000, 4014)) and got[1].n_words == 4014
    assert got[2]["items"] == got[3]["items"] == []


def test_stage_keeps_clean_documents_with_their_columns(spark, tmp_path):
    """Null ids and texts, clashing columns, an empty table."""
    spark.createDataFrame([(1, " ".join(vocabulary(20, "s")))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, " ".join(vocabulary(20, "s")), "a"), (2, "clean text", "b"), (None, None, "c"), (None, " ".join(vocabulary(20, "s")), "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    out = decontam.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.where("items IN ('b', 'c')").collect()))
    assert decontam.stage(spark, docs.where("false"), str(tmp_path)).count() == 0
