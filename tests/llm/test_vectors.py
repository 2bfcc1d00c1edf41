import numpy as np
import pytest

from barline.llm import vectors


def brute(rows, threshold=0.98):
    good = {}
    for k, (i, v, lab) in enumerate(rows):
        if i is not None and v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            good[k] = x / np.sqrt((x * x).sum())
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                links[a].add(b)
                links[b].add(a)
    least = {i: i for i, _, _ in rows if i is not None}
    for _ in range(len(rows)):
        before = dict(least)
        for a in links:
            for b in links[a]:
                m = min(least[rows[a][0]], least[rows[b][0]])
                least[rows[a][0]] = least[rows[b][0]] = m
        if before == least:
            break
    n = {}
    for a in links:
        if rows[a][0] is not None:
            n[rows[a][0]] = n.get(rows[a][0], 0) + len(links[a])
    return sorted(((i, n.get(i, 0), least.get(i), i == least.get(i)) for i, _, _ in rows), key=str)


@pytest.mark.parametrize("ks,label_rows,split_rows,block_rows,numbers", [((4, 16, 64, 256), 64, 6000, 1500, 1 << 23), ((2, 4), 20, 12, 2000, 1 << 23), ((3,), 8, 6, 7, 1 << 23), ((4, 100), 20, 20, 7, 40), ((4,), 10_000, 10_000, 5, 1 << 23)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, ks, label_rows, split_rows, block_rows, numbers):
    """Cells of one to three levels, more cells than a long has bits, whole labels, and centroids for some labels only."""
    for name, value in (("KS", ks), ("LABEL_ROWS", label_rows), ("SPLIT_ROWS", split_rows), ("BLOCK_ROWS", block_rows), ("CENTRE_NUMBERS", numbers), ("WORTH", 4.0), ("SEND", 0)):
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(5)
    rows, k = [], 0
    for lab in (1, 2, 3):
        for _ in range(15):
            base = r.normal(size=8)
            for _ in range(int(r.integers(1, 9))):
                rows.append((k, (base * r.uniform(0.5, 2) + r.normal(size=8) * 0.12).tolist(), lab))
                k += 1
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [1.0, float("nan")] + [0.0] * 6, 1), (1003, [1.0, None] + [0.0] * 6, 1), (1004, rows[0][1], None), (1005, [], 1), (1006, [float("inf")] * 8, 1), (1007, rows[0][1], 1), (1008, rows[0][1], 2), *[(1100 + x % 7, rows[3][1], 1) for x in range(40)], (None, rows[0][1], 1), (1009, [1.0, 2.0], 1), (1010, [2.0, 4.0], 1)]
    spark.createDataFrame([(*x, 9) for x in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in vectors.op4_embedding_dedup(spark, str(tmp_path)).collect()), key=str)
    want = [(i, n, c, None if i is None else kept) for i, n, c, kept in brute(f32)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == (g[0] == g[2]) for g in got)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vectors.op4_embedding_dedup(spark, str(tmp_path)).count() == 0


def test_exactly_at_the_threshold(spark, tmp_path):
    """The cosine of (1, 0, 0, 0) and (49, 7, 5, 5) is 0.98 exactly, whatever the scale; a little more of the others is below it."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [x * 2.0**600 for x in (49, 7, 5, 5)]), (3, [49, 7.0000001, 5, 5]), (4, [-1.0, 0.0, 0.0, 0.0])]
    spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in rows], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.vec_id: (x.n_links, x.component_id) for x in vectors.op4_embedding_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (0, 4)}


def test_cells_prune_clustered_vectors():
    """On well separated clusters the cells that the sample promises least work for are many, and hardly any vector is sent twice."""
    r = np.random.default_rng(1)
    x = vectors.unit(np.repeat(r.normal(size=(200, 32)), 20, axis=0) + r.normal(size=(4000, 32)) * 0.02)
    near = vectors.reach(x, vectors.spherical_kmeans(x, 64), 0.98)
    assert (near.sum(axis=0) ** 2).sum() < 0.1 * len(x) ** 2 and near.sum() < 2 * len(x)


def test_every_label_gets_cells(spark):
    """With production parameters, the small labels of a small table are split as large ones are."""
    own = vectors.clean(vectors.read(spark, "/root/testdata/sf0.01", "embeddings"))
    nodes = own.select("label", vectors.F.monotonically_increasing_id().alias("node"), vectors.F.lit(1).cast("long").alias("copies"), "v")
    cells = {}
    for r in vectors.in_cells(vectors.staged(nodes, "nodes"), vectors.THRESHOLD).select("cell").collect():
        label, *rest = r.cell.split("/")
        cells.setdefault(label, set()).add(tuple(rest))
    assert len(cells) == 10 and all(len(c) > 1 and () not in c for c in cells.values())
