import hashlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from barline.llm import product_codes


def plain(rows):
    """Lloyd's rounds by the letter, in Python's integers. rows: (vec_id, label, vector)."""
    ok = [r for r in rows if r[2] and all(x is not None and np.isfinite(x) for x in r[2])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not ok:
        return []
    ok = [r for r in ok if len(r[2]) == len(ok[0][2])]
    width = -(-len(ok[0][2]) // 4)
    q = [[Fraction(x) * 1024 // 1 for x in r[2]] + [0] * (4 * width - len(r[2])) for r in ok]
    cut = [[v[p * width : (p + 1) * width] for p in range(4)] for v in q]
    books = [[c[p] for c in cut[:256]] for p in range(4)]

    def near(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(4):
        for p in range(4):
            of = {}
            for c in cut:
                of.setdefault(near(c[p], books[p])[0], []).append(c[p])
            books[p] = [[sum(x) // len(of[e]) for x in zip(*of[e], strict=True)] if e in of else books[p][e] for e in range(len(books[p]))]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(4)] for c in cut]
    errors = [min(2**63 - 1, sum(d for _, d in f)) for f in found]
    labels = {x: min(2**63 - 1, sum(e for r, e in zip(ok, errors, strict=True) if r[1] == x)) for x in {r[1] for r in ok}}
    return [(r[0], "".join(f"{e:02x}" for e, _ in f), err, labels[r[1]], digest) for r, f, err in zip(ok, found, errors, strict=True)]


def run(spark, tmp_path, rows, kind="float"):
    spark.createDataFrame([(*r, "clash", 3) for r in rows], f"vec_id long, label int, embedding array<{kind}>, code string, owner int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return [tuple(r) for r in product_codes.op13_vector_codes(spark, str(tmp_path)).collect()]


def test_against_plain_rounds(spark, tmp_path, monkeypatch):
    """Hot vectors, repeats, nulls, ties and odd rows; owners of few members, so that members migrate over many."""
    monkeypatch.setattr(product_codes, "OWNER_MEMBERS", 100)
    rng = np.random.default_rng(1)
    rows = [(k, int(k % 3) if k % 7 else None, np.float32(rng.normal(0, 0.3, 8)).tolist()) for k in range(300)]
    rows += [(1000 + k, 1, [0.25] * 8) for k in range(150)] + [(5, 2, [0.5] * 8), (5, 2, [0.5] * 8), (None, 1, [0.1] * 8)]
    rows += [(2000, 1, None), (2001, 1, [float("nan")] * 8), (2002, 1, [float("inf")] + [0.0] * 7), (2003, None, [None] + [0.0] * 7), (2004, 1, [0.0] * 4), (2005, 1, [])]
    got = run(spark, tmp_path, rows)
    assert Counter(got) == Counter(plain(rows)) and len(got) == 453


@pytest.mark.parametrize("size", [1e6, 1e12, 1e18])
def test_large_components_and_few_rows(spark, tmp_path, size):
    """Fewer rows than entries, a length that four does not divide, components beyond exact doubles."""
    rng = np.random.default_rng(2)
    rows = [(k, 0, (rng.normal(0, 1, 6) * size).tolist()) for k in range(12)] + [(k, 1, [0.5, -0.5, 0.25, 0.0, 1.0, -1.0]) for k in range(12, 20)]
    rows += [(20 + k, 0, (np.array(rows[k][2]) * 1.01).tolist()) for k in range(12)]
    assert Counter(run(spark, tmp_path, rows, "double")) == Counter(plain(rows))


def test_movers_only_are_shuffled(spark):
    """A member that keeps its entry keeps its owner; one that changes it goes where its new entry and its salt say."""
    rng = np.random.default_rng(4)
    rows = rng.integers(-500, 500, (400, 2)).astype(np.int16)
    books = [rng.integers(-500, 500, (16, 2)) for _ in range(2)]
    entry = product_codes.nearest(rows, books[0])[0]
    owners, salts = 11, np.arange(400) % 11
    owner = (entry * product_codes.SPREAD + salts) % owners
    broadcast = type("Shared", (), {"value": [books[1]] * 4})
    new = product_codes.nearest(rows, books[1])[0]
    want = Counter((int((e * product_codes.SPREAD + s) % owners), int(e)) for e, s in zip(new, salts, strict=True))
    got, stayed = Counter(), 0
    for k in range(owners):
        mine = product_codes.Members(np.zeros(400), entry, rows).take(owner == k)
        for to, packed, keep in product_codes.judge(broadcast, owners)(k, iter([(k, product_codes.pickle.dumps(mine))])):
            members = product_codes.pickle.loads(packed)
            got.update((to, int(e)) for e in members.entry)
            assert keep == (to == k)
            stayed += len(members.rows) * keep
    assert got == want and stayed >= (entry == new).sum()


def test_many_labels(spark, monkeypatch):
    coded = spark.createDataFrame([(k, k % 50 if k % 3 else None, "00", k) for k in range(900)], "vec_id long, label int, code string, error long")
    few = sorted(map(str, product_codes.with_label_errors(coded).collect()))
    monkeypatch.setattr(product_codes, "MOST_LABELS", 5)
    assert sorted(map(str, product_codes.with_label_errors(coded).collect())) == few


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
