import random
import re

import pytest

from barline.llm import jaccard
from barline.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    ids = sorted({d for d, _ in rows if d is not None})
    sets = [(k, d, shingles(t)) for k, (d, t) in enumerate(rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, d, s in sets:
        for j, e, t in sets[:i]:
            n = len(s & t)
            if (d is not None and d == e) or (s and t and 100 * n >= 80 * len(s | t)):
                root[find(i)] = find(j)
    least = {}
    for k, d, _ in sets:
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    assert ids is not None
    return sorted(((d, len(s), least.get(find(k))) for k, d, s in sets), key=str)


def corpus(seed, families=12, copies=14):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows, k = [], 1
    for f in range(families):
        base = [r.choice(vocab) for _ in range(r.choice([6, 9, 40, 90, 150]))]
        if f % 3 == 0:
            base[5:5] = passage
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = r.choice(["new", "x", *vocab])
            if r.random() < 0.3:
                w = w[: max(1, len(w) - r.randrange(12))]
            rows.append((k, " ".join(w) if r.random() < 0.8 else "\n ".join(w).upper()))
            k += 1
    return rows


def crowded(r):
    """Boilerplate that many unlinked texts share, next to a component of many near copies that shares it too."""
    base = [f"b{k}" for k in range(12)]
    rows = [(5000 + k, " ".join([*base, *(f"u{k}x{j}" for j in range(3 + k % 4))])) for k in range(60)]
    return rows + [(6000 + k, " ".join([*base, *(f"c{j}" for j in range(60)), f"z{k}"])) for k in range(60)]


@pytest.mark.parametrize("seed,group,block,halves", [(1, 20_000, 500, None), (2, 3, 500, None), (3, 20_000, 7, None), (4, 3, 5, None), (5, 20_000, 500, 40), (6, 4, 6, 25)])
def test_equals_brute_force(spark, seed, group, block, halves, monkeypatch, tmp_path):
    """Salted and unsalted groups, blocks of the second round, and keys so short that many sets share one."""
    monkeypatch.setattr(jaccard, "GROUP_POSTINGS", group)
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    if halves:
        whole = jaccard.set_key
        monkeypatch.setattr(jaccard, "set_key", lambda h: (whole(h)[0] % halves, whole(h)[1]))
    monkeypatch.setattr(jaccard, "HEAVY_LEAST", 3)
    rows = corpus(seed) + (crowded(random.Random(seed)) if seed > 2 else []) + [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "One  TWO"), (905, "one two three"), (None, "one two"), (None, "lonely text without an id at all"), (None, None), (5, "a second text under an id that has one"), (7, corpus(seed)[6][1]), (906, "word " * 3000), (907, "word " * 4000)]
    random.Random(0).shuffle(rows)
    spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, n long, key string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op2_jaccard_join(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)
    if seed == 1:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        kept = jaccard.stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        ids = sorted((r.doc_id for r in kept.collect()), key=str)
        assert ids == sorted([d for d in {d for d, _, c in brute(rows) if d is not None and c == d}] + [None] * 3, key=str)


def test_heavy_cells_are_the_most_frequent_of_all_buckets(spark, monkeypatch):
    """The counts kept are those of the HEAVY most frequent cells, whatever buckets they are in."""
    monkeypatch.setattr(jaccard, "HEAVY", 5)
    monkeypatch.setattr(jaccard, "HEAVY_LEAST", 2)
    texts = [f"common {k} one two three" for k in range(6) for _ in range(10 + k)] + [f"rare {k} a b c" for k in range(50)]
    order = jaccard.count_shingles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    assert sorted(order.counts.tolist()) == [11, 12, 13, 14, 15]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, None), (9, 9)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {}
    for _ in range(100):
        for a, b in edges:
            if b is not None and a != b:
                m = min(least.get(a, a), least.get(b, b))
                least[a] = least[b] = m
    assert got == least


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert jaccard.op2_jaccard_join(spark, str(tmp_path)).count() == 0
