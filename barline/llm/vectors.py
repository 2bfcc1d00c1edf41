"""Op 4: near-duplicate vectors by spherical k-means cells and blocked cosine products.

1. Equal vectors of a label are one node with a number of copies, so that large groups of copies are aggregated before any
   comparison. Nodes are unit vectors of doubles.
2. Groups (first the labels, then cells that are still large, LEVELS times at most) are split into cells by spherical
   k-means, fitted on a bounded sample of the group (SAMPLE rows on average, by a hash of the vector). The number of cells is
   the one of KS for which the sample promises the least work, comparisons and copies sent; labels of two
   vectors and more always get cells, a large cell that cells would not help stays whole.
3. Two unit vectors of cosine >= t are at most d = sqrt(2 - 2t) apart. If they lie in different cells c1 and c2, one of
   them is within d / 2 of the plane that halves c1 and c2. So a vector is also sent to each cell whose plane is so near:
   two such vectors meet in some cell, at every level. Each row keeps the cells before its own that it was sent to as well (column
   earlier), and a pair counts only in the first cell in which it meets. No link is lost or counted twice: the search is exact.
4. A cell's vectors are dealt over blocks of about BLOCK_ROWS; each pair of blocks is one product of two matrices. Links
   are counted for each vector, and a block pair gives back only as many edges as connect what it has found linked.
5. Components of those edges; the smallest id of each is kept.

The centroids of at most CENTRE_NUMBERS numbers a level are sent to the workers, for the largest groups first; groups beyond
stay whole, which is exact too. A cell that does not split (vectors all alike but not equal) costs the product of all its
pairs in blocks, since each pair of it is a link to be counted.

Defined results: vectors that are null, empty, zero, of another length than most of their block, or hold null or non-finite
components, and vectors of null label, link with nothing and are kept; rows that repeat a vec_id are vectors of their own
for the links but share the id's component and counts; a null vec_id links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, salted_join, staged
from .components import connected_components

THRESHOLD = 0.98
SAMPLE = 4_000
#: Numbers of cells tried; the least rows of a label, and of a cell, to be split; levels of splitting; numbers in all centroids of a level.
KS, LABEL_ROWS, SPLIT_ROWS, LEVELS, CENTRE_NUMBERS = (2, 4, 16, 64, 256), 2, 6_000, 3, 8 << 20
BLOCK_ROWS = 1_500
ROUNDS = 12
#: Labels always get cells; cells of cells must bring a group's work down to this share. A vector sent to a block of a cell costs as much as SEND comparisons (less in groups of one block).
WORTH, SEND = 0.8, 4_000


def clean(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, v: rows that can link, as arrays of doubles."""
    own = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by powers of two first, so that no square overflows and no digit is lost."""
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit rows; starts from rows spread evenly over the sample, the same at every run."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(axis=1))
        moved = norm > 1e-9
        centre[moved] = total[moved] / norm[moved, None]
    return np.unique(centre, axis=0)


def reach(x: np.ndarray, centre: np.ndarray, threshold: float) -> np.ndarray:
    """rows x cells: the nearest cell of each unit row, and those in which a vector of that cosine may lie."""
    score = x @ centre.T
    first = score.argmax(axis=1)
    gap = score[np.arange(len(x)), first][:, None] - score
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centre @ centre.T)))[first]
    near = gap <= (np.sqrt(2 - 2 * threshold) / 2 + 1e-9) * apart + 1e-12
    near[np.arange(len(x)), first] = True
    return near


def fit_cells(nodes: DataFrame, least: int, threshold: float, worth: float) -> dict[str, np.ndarray]:
    """Centroids of each group (column cell) of at least `least` rows that is worth splitting."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        width = frame.v.map(len).mode().iloc[0]
        x = np.array([v for v in frame.sort_values("node").v if len(v) == width])
        n = float(frame["rows"].iloc[0])
        send = SEND if n > BLOCK_ROWS else n / 8
        cost = lambda cells: (cells**2 + send * cells * np.maximum(1, cells / BLOCK_ROWS)).sum()
        best, work = None, worth * cost(np.array([n]))
        for k in KS:
            if 8 * k > len(x) and k > KS[0]:
                break
            centre = spherical_kmeans(x[::2], k)
            other = x[1::2] if len(x) > 1 else x  # rows the centroids have not seen tell how far vectors spread over cells
            needed = cost(reach(other, centre, threshold).sum(axis=0) * (n / len(other)))
            if needed < work:
                best, work = centre, needed
        found = [] if best is None else [(frame.cell.iloc[0], best.ravel().tolist(), width)]
        return pd.DataFrame(found, columns=["cell", "centres", "width"])

    spark = nodes.sparkSession
    sizes = nodes.groupBy("cell").agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("width")).where(F.col("rows") >= least)
    # each group takes KS[0] centroids at least, so this bounds the rows that are broadcast
    sizes = sizes.orderBy(F.desc("rows"), "cell").limit(CENTRE_NUMBERS // KS[0]).select("cell", "rows", F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("rows")).alias("share"))
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    chosen = nodes.select("cell", "node", "v").join(F.broadcast(sizes), "cell").where(drawn < F.col("share")).drop("share")
    fitted = staged(chosen.groupBy("cell").applyInPandas(fit, "cell string, centres array<double>, width bigint"), "centroids")
    w = F.sum(F.size("centres")).over(Window.orderBy(F.desc("size"), "cell"))
    # one row a split group: the window runs over at most CENTRE_NUMBERS / KS[0] of them
    kept = fitted.withColumn("size", F.size("centres")).withColumn("before", w - F.col("size")).where(F.col("before") < CENTRE_NUMBERS)
    return {r.cell: np.array(r.centres).reshape(-1, r.width) for r in kept.select("cell", "centres", "width").collect()}


def send_to_cells(nodes: DataFrame, centres: dict[str, np.ndarray], threshold: float, level: int) -> DataFrame:
    """nodes (cell, earlier, node, v) of split groups in their new cells: once in each that reach() names."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)  # CENTRE_NUMBERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for cell, rows in frame.groupby("cell"):
                c = shared.value.get(cell)
                for width, part in rows.groupby(rows.v.map(len)):
                    if c is None or c.shape[1] != width:
                        yield pa.RecordBatch.from_pandas(part.assign(cell=f"{cell}/{width}" if c is not None else cell), batch.schema, preserve_index=False)
                        continue
                    near = reach(np.stack(part.v.to_numpy()), c, threshold)
                    at, k = np.nonzero(near)
                    names = np.array([f"{cell}/{j}" for j in range(len(c))])
                    token = level << 20 | np.arange(len(c))
                    earlier = [[*part.earlier.iloc[i], *token[np.flatnonzero(near[i, :j])].tolist()] for i, j in zip(at.tolist(), k.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[k]), pa.array(earlier, pa.list_(pa.int64())), pa.array(part.node.to_numpy()[at]), pa.array(part.copies.to_numpy()[at]), pa.array(list(np.stack(part.v.to_numpy())[at]), pa.list_(pa.float64()))], names=["cell", "earlier", "node", "copies", "v"])

    return nodes.select("cell", "earlier", "node", "copies", "v").mapInArrow(run, "cell string, earlier array<bigint>, node bigint, copies bigint, v array<double>")


def met_before(a: list, b: list) -> np.ndarray:
    """Which pairs share a cell before this one: rows of a against rows of b, each a list of cells."""
    def patterns(x):
        keys = [tuple(e) for e in x]
        own = {p: k for k, p in enumerate(dict.fromkeys(keys))}
        return list(own), np.array([own[p] for p in keys], int)

    (pa_, at), (pb, bt) = patterns(a), patterns(b)
    cells = {c: k for k, c in enumerate({c for p in pa_ for c in p} & {c for p in pb for c in p})}
    if not cells:
        return np.zeros((len(a), len(b)), bool)
    sides = []
    for ps in (pa_, pb):
        m = np.zeros((len(ps), len(cells)), np.float32)
        for i, p in enumerate(ps):
            m[i, [cells[c] for c in p if c in cells]] = 1
        sides.append(m)
    return (sides[0] @ sides[1].T > 0)[np.ix_(at, bt)]


def block_links(a: tuple, b: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links inside block a, or between a and b (each node, v, copies, earlier): linked nodes, how many vectors they link with, and for each a node of its component."""
    other = a if b is None else b
    part = a[1] @ other[1].T >= threshold
    if b is None:
        np.fill_diagonal(part, False)
    rows, cols = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
    part = part[np.ix_(rows, cols)] & ~met_before([a[3][i] for i in rows], [other[3][i] for i in cols])
    if b is None:
        ids, copies, link = a[0][rows], a[2][rows], part
    else:
        ids, copies = np.concatenate([a[0][rows], b[0][cols]]), np.concatenate([a[2][rows], b[2][cols]])
        link = np.zeros((len(ids), len(ids)), bool)
        link[: len(rows), len(rows) :], link[len(rows) :, : len(rows)] = part, part.T
    linked = np.flatnonzero(link.any(axis=1))
    link, ids, copies = link[np.ix_(linked, linked)], ids[linked], copies[linked]
    counts, label = (link * copies[None, :]).sum(axis=1) if len(linked) else copies, np.arange(len(linked))
    while len(linked):
        best = np.minimum(label, np.where(link, label[None, :], len(linked)).min(axis=1))
        best = best[best]
        if (best == label).all():
            break
        label = best
    return ids, counts, ids[label]


def compare_cells(cells: DataFrame, threshold: float) -> DataFrame:
    """(node, n, other): vectors linked in each pair of blocks, and an edge to a node of the same component."""
    size = cells.groupBy("cell").agg(F.count("*").alias("rows"))
    dealt = salted_join(cells, size, ["cell"], F.col("node")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("cell", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "copies", "earlier", "v")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = int(frame.x.iloc[0]), int(frame.y.iloc[0])
        found = []
        for _, same in frame.groupby(frame.v.map(len)):
            a = same[same.block == x]
            b = a if x == y else same[same.block == y]
            pack = lambda f: (f.node.to_numpy(), np.stack(f.v.to_numpy()), f.copies.to_numpy(np.int64), f.earlier.tolist())
            if len(a) and len(b):
                found.append(pd.DataFrame(dict(zip(("node", "n", "other"), block_links(pack(a), None if x == y else pack(b), threshold), strict=True))))
        return pd.concat(found) if found else pd.DataFrame({"node": [], "n": [], "other": []})

    return pairs.groupBy("cell", "x", "y").applyInPandas(run, "node bigint, n bigint, other bigint")


def in_cells(nodes: DataFrame, threshold: float) -> DataFrame:
    """nodes (label, node, copies, v) as rows of cells: cell, earlier, node, copies, v."""

    def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for _, part in frame.groupby(frame.v.map(len)):
                yield pa.RecordBatch.from_pandas(part.assign(v=list(unit(np.stack(part.v.to_numpy())))), batch.schema, preserve_index=False)

    now = nodes.select(F.hex("label").alias("cell"), F.array().cast("array<bigint>").alias("earlier"), "node", "copies", "v")
    now, done = staged(now.mapInArrow(unit_rows, now.schema), "vectors"), None
    for level in range(LEVELS):
        centres = fit_cells(now, LABEL_ROWS if level == 0 else SPLIT_ROWS, threshold, WORTH if level else np.inf)
        if not centres:
            break
        split = F.col("cell").isin(list(centres)) if len(centres) < 100 else F.lit(True)
        rest = now.where(~split)
        done = rest if done is None else done.unionAll(rest)
        now = staged(send_to_cells(now.where(split), centres, threshold, level), "vector-cells")
    return now if done is None else now.unionAll(done)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row for each row of vectors: vec_id, n_links, component_id, kept."""
    own = clean(vectors, id_col, vector, label).withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.reverse("v"), "label")})
    nodes = own.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")  # written once, so the numbers stay
    rows = staged(own.select("vec_id", "k1", "k2"), "vector-rows")
    found = staged(compare_cells(in_cells(nodes, threshold), threshold), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    names = nodes.select(F.col("node"), "least")
    edges = found.select("node", "other").join(names.select("node", F.col("least").alias("a")), "node").join(names.select(F.col("node").alias("other"), F.col("least").alias("b")), "other").select("a", "b")
    # an id in several nodes is one document: they are linked
    first = salted_join(rows, nodes.select("k1", "k2", "node", "copies", "least"), ["k1", "k2"], F.col("vec_id"))
    shared = first.groupBy("vec_id").agg(F.min("least").alias("a"), F.max("least").alias("z")).where("a <> z")
    several = first.join(shared, "vec_id").select("a", F.col("least").alias("b")).distinct()
    parts = connected_components(edges.unionAll(several))
    named = nodes.select("k1", "k2", "node", "copies", "least").join(counts, "node", "left").join(parts.select(F.col("node").alias("least"), "root"), "least", "left")
    named = named.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "least").alias("root"))
    by_id = salted_join(rows, named, ["k1", "k2"], F.col("vec_id")).groupBy(F.col("vec_id").alias("i")).agg(F.sum("n").alias("n"), F.min("root").alias("root"))
    ids = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"))
    out = ids.join(by_id, F.col("vec_id") == F.col("i"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector: vec_id, n_links, component_id, kept."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a), c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
