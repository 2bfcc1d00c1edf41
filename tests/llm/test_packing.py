import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def expanded(counts, capacity):
    """Every piece of a plan: (length, rank, sequence, offset)."""
    slots = packing.plan(counts, capacity)
    keys = [(s[0], s[1]) for s in slots.tolist()]
    assert keys == sorted(set(keys))
    out = []
    for length in np.flatnonzero(counts):
        own = slots[slots[:, 0] == length]
        for rank in range(counts[length]):
            _, first, each, sequence, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1].tolist()
            out.append((int(length), rank, sequence + (rank - first) // each, offset + (rank - first) % each * int(length)))
    return out


def check(placed, capacity):
    """Pieces stand gapless from 0 in sequences of at most capacity; returns the number of sequences."""
    by = {}
    for length, _, sequence, offset in placed:
        by.setdefault(sequence, []).append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def decreasing(counts, capacity):
    """Plain best fit decreasing, a piece at a time."""
    free = []
    for length in range(capacity, 0, -1):
        for _ in range(counts[length]):
            best = min((f for f in free if f >= length), default=None)
            if best is not None:
                free.remove(best)
            free.append((capacity if best is None else best) - length)
    return len(free)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 24).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(0, 9), min_size=c + 1, max_size=c + 1))))
def test_plans_hold_every_piece_once(case):
    capacity, counts = case
    counts = np.array([0, *counts[1:]])
    used = check(expanded(counts, capacity), capacity) if counts.sum() else 0
    assert used <= decreasing(counts, capacity)
    assert used >= -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)


def test_best_fit_on_counts_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = rng.integers(0, 6, 41) * (rng.random(41) < 0.4)
        counts[0] = 0
        assert sum(n for _, n in packing.best_fit(counts.copy(), 40)) == decreasing(counts, 40)


def test_most_sequences_come_from_fitted_patterns():
    """With all lengths at hand the fit covers nearly everything and no room is wasted."""
    rng = np.random.default_rng(5)
    counts = np.bincount(np.minimum(128, rng.geometric(0.02, 20_000)), minlength=129)
    left = counts.copy()
    table = packing.patterns(left > 0, 128)
    fitted = sum(n for _, n in packing.rounded(packing.fit(table, counts), table, left))
    least = -(-int((counts * np.arange(129)).sum()) // 128)
    assert (left >= 0).all() and fitted > 0.5 * least
    assert check(expanded(counts, 128), 128) <= 1.001 * least + 1


def test_patterns_are_all_triples():
    there = np.zeros(31, bool)
    there[[1, 4, 9, 10, 11, 16, 20, 30]] = True
    want = {(0, 0, 30)} | {(a, b, 30 - a - b) for a in (0, *np.flatnonzero(there)) for b in np.flatnonzero(there) if a <= b <= 30 - a - b and there[30 - a - b]}
    assert {tuple(r) for r in packing.patterns(there, 30).tolist()} == want


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (19, [(0, 3), (3, 8), (11, 8)])])
def test_cut(n, want):
    assert packing.cut(n, 8) == want


DOCS = [(5, "the cat sat on the mat\nand it's 42"), (1, None), (9, ""), (3, "  odd   spaces \n\n here "), (3, "same id"), (None, "no id"), (12, "long " * 3000), (7, "x\ny"), (7, "x\ny")] + [(k, f"document number {k} " * (k % 90)) for k in range(20, 200)]


def test_query(spark, tmp_path):
    """Ids, cuts and digests against the library; every piece once, gapless, in few sequences."""
    spark.createDataFrame([(d, t, 1, 2) for d, t in DOCS], "doc_id long, text string, length int, task int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op11_packing(spark, str(tmp_path)).collect()
    want = []
    for d, t in DOCS:
        ids = np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    counts = np.bincount([r.length for r in got], minlength=1025)
    assert check([(r.length, 0, r.sequence_id, r.offset) for r in got], 1024) <= decreasing(counts, 1024)


def test_sequences(spark):
    """The packed ids are the pieces' ids at their places."""
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 13)) for k in range(150)], "doc_id long, text string").repartition(3)
    parts = packing.staged(packing.pieces(docs, PATH, 32), "pieces")
    ids = {(r.doc_id, r.piece): bytes(r.ids) for r in parts.collect()}
    seen = set()
    for r in packing.sequences(parts, 32).collect():
        assert b"".join(ids[d.doc_id, d.piece] for d in r.documents) == bytes(r.ids) and len(r.ids) <= 4 * 32
        seen |= {(d.doc_id, d.piece) for d in r.documents}
    assert seen == set(ids)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert packing.op11_packing(spark, str(tmp_path)).count() == 0
