import zlib
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from barline.llm import unigram


@lru_cache
def vocab():
    return unigram.vocabulary(unigram.model_path())


@lru_cache
def functions():
    v = vocab()
    return unigram.over_runs(v, unigram.encoder(v), b"".join), unigram.over_runs(v, unigram.counter(v), sum)


def brute(text):
    """All starts for every end, in plain loops over the whole text."""
    v = vocab()
    s = unigram.MARK + text.replace(" ", unigram.MARK) if text else ""
    best = [(0.0, 0, [])]
    for end in range(1, len(s) + 1):
        top = None
        for start in range(end):
            p = s[start:end]
            if p in v.scores:
                c = (best[start][0] + v.scores[p][1], start, [v.scores[p][0]])
            elif end - start == 1:
                c = (best[start][0] + v.unknown_score, start, v.unknown(p))
            else:
                continue
            if top is None or c[0] > top[0]:
                top = c
        best.append(top)
    out, end = [], len(s)
    while end:
        out = best[end][2] + out
        end = best[end][1]
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("theanis  \n.é漢\U0001F600▁\t1")), max_size=40))
def test_equals_brute_force(text):
    encode, count = functions()
    want = brute(text)
    assert np.frombuffer(encode(text), "u4").tolist() == want
    assert count(text) == len(want)
    if unigram.MARK not in text:
        assert unigram.decode(vocab(), want) == text


def test_queries(spark, tmp_path):
    rows = [(1, "the cat"), (2, None), (3, ""), (4, "a  b\n\nc"), (4, "a  b\n\nc"), (None, "漢"), (5, "word" * 5000), (6, "x y " * 3000)]
    spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, n_tokens string, ids int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((d, len(brute(t or "")) if len(t or "") < 9000 else None) for d, t in rows), key=str)
    small = [w for w in want if w[1] is not None]
    counts = sorted(((r.doc_id, r.n_tokens) for r in unigram.op3_token_counts(spark, str(tmp_path)).collect()), key=str)
    encoded = unigram.op7_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in encoded), key=str) == counts
    assert [c for c in counts if c[0] not in (5, 6)] == [w for w in small if w[0] not in (5, 6)]
    assert all(r.decoded_equal for r in encoded)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    back = unigram.decode_ids(unigram.encode_texts(docs, unigram.model_path(), keep=["doc_id"]), unigram.model_path()).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t in rows)


def test_empty(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert unigram.count_tokens(d, unigram.model_path()).count() == 0 and unigram.encode_texts(d, unigram.model_path()).count() == 0
