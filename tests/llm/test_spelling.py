import random
import re
import zlib
from collections import Counter

import pytest

from barline.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 3}


def grouped(vocabulary):
    form, out = {}, {}
    for w, n in vocabulary.items():
        best = sorted((-vocabulary[x], x) for x in vocabulary if near(w, x))
        form[w] = best[0][1] if best and -best[0][0] >= 2 * n else None
        out[w] = len(best)
    rows = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], vocabulary[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def run(spark, vocabulary):
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3)
    return sorted(map(tuple, spelling.spelling(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def variants(rng, base, letters, steps):
    out = {base}
    while len(out) < steps:
        w = rng.choice(sorted(out))
        i = rng.randrange(len(w) + 1)
        v = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
        if len(v) >= 5:
            out.add(v)
    return out


@pytest.mark.parametrize("block,cells", [(512, 1 << 22), (4, 1 << 22), (512, 600)])
def test_against_all_pairs(spark, monkeypatch, block, cells):
    """Dense groups of short words, groups beyond BLOCK (bands of width one), blocks of few rows, ties, long words, letters up to U+00FF."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "TILE_CELLS", cells)
    rng = random.Random(7)
    words = set()
    for base in ("abcde", "ééàßÿ", "internationalisation", "aaaaaaa", "x" * 3000):
        words |= variants(rng, base, "abé", 60)
    words |= {"abcde" + c for c in "abcdefghijkl"} | {c + "bcde" for c in "abcdefghijkl"}
    vocabulary = {w: rng.choice([3, 3, 4, 6, 9, 13, 27, 60, 200]) for w in words}
    assert run(spark, vocabulary) == grouped(vocabulary)


def test_bands_cover_each_prefix_once(spark):
    for m in (5, 6, 9, 23):
        for n in (4, m):
            got = spark.range(1).select(spelling.bands(spelling.F.lit(m), spelling.F.lit(n)).alias("b")).first().b
            assert [p for b in got for p in range(b.low, b.high)] == list(range(m))


def test_chains_of_forms(spark):
    """Roots at the end of long chains."""
    letters = "abcdefghijkl"
    vocabulary = {"zz" + letters[:k] + "q" * (12 - k): 3 * 2**k for k in range(12)}
    rows = run(spark, vocabulary)
    assert rows == grouped(vocabulary) and len({r[2] for r in rows}) == 1


def test_query(spark, tmp_path):
    """Whole texts: deletions by hash, nulls, repeats, clashing columns, letters beside others."""
    rng = random.Random(3)
    base = ["Wonder", "wander", "WONDERS", "naïveté", "naivete", "façade", "facade", "hello×world", "abcd", "straße", "strasse"]
    docs = [(k, " ".join(rng.choice(base) + rng.choice(["", ", ", "1", "漢", "Ā"]) for _ in range(60))) for k in range(300)]
    docs += [(None, "wonder wander " * 40), (7, None), (8, ""), (9, "1 2 ,"), (3, docs[3][1]), (10, "y" * 20_000 + " " + ("y" * 20_000 + " ") * 2)]
    spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, word string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, spelling.op12_spelling(spark, str(tmp_path)).collect()), key=str)
    assert got == grouped(counted(docs)) and len(got) > 15


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert spelling.op12_spelling(spark, str(tmp_path)).count() == 0
