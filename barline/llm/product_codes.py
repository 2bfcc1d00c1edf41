"""Op 13: vectors as codes of one byte for each of four parts, by Lloyd's rounds in which members stay with their owners.

Components become integers, floor(1024 x), so sums, means and distances are exact and every engine finds the same codebooks.

Layout: each part (a quarter of a vector) is a member of the entry it is nearest to. Members are dealt to owners by (position,
entry, salt): owner = (entry's number * SPREAD + salt) mod owners, the salt from 0 to owners - 1. A key of any size is so dealt
evenly over all owners, and a member that changes its entry but keeps its salt has one new owner that follows from the old one.

A round: owners sum their resident members by entry; sums are combined before and after the shuffle, and the new codebooks (4 x
256 entries) go to the driver and back. Owners then find each resident's nearest entry. Who keeps it stays where it is: the
stayers' dataset keeps its partitioning and is joined, partition by partition, with the movers, the only rows that are shuffled.
The layout is written to the shared folder (checkpoint), and so is each CHECKPOINT_ROUNDS-th round; a lost executor costs the
rounds since.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped, and so are vectors whose
length differs from that of the smallest vec_id's (and empty ones); a length that four does not divide is padded with zeros; a null vec_id sorts
last; repeated rows count each (ties of vec_id by the vector); with fewer than 256 rows there are as many entries; components
of any size are exact (beyond 2^53 in Python's integers, slowly), and sums of errors stop at 2^63 - 1; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, salted_join, shared_dir, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Members of an owner, the step between the owners of two entries, rounds between checkpoints, rows of a block of distances.
OWNER_MEMBERS, SPREAD, CHECKPOINT_ROUNDS, BLOCK = 400_000, 7919, 4, 4096
#: Most labels whose sums are broadcast; beyond it they are joined.
MOST_LABELS = 4096
LARGEST = 2**63 - 1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) of finite doubles as integers: the narrowest type that holds them, Python's own beyond 2^53."""
    if not x.size or np.abs(x).max() < 2.0**43:
        q = np.floor(x * SCALE).astype(np.int64)
        size = np.abs(q).max(initial=0)
        return q.astype(np.int16) if size < 2**15 else q.astype(np.int32) if size < 2**31 else q
    return np.array([[int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in row] for row in x.tolist()], object)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers, the nearest entry (the first of equals) and the squared distance, exactly."""
    entry, dist = np.zeros(len(x), np.int64), []
    most = max((int(abs(a).max()) for a in (x, book) if a.size), default=0)
    bound = 4 * most * most * x.shape[1]
    wide = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    book = book.astype(wide)
    squares = (book * book).sum(axis=1)
    for a in range(0, len(x), BLOCK):
        own = x[a : a + BLOCK].astype(wide)
        d = (own * own).sum(axis=1)[:, None] - 2 * (own @ book.T) + squares
        k = d.argmin(axis=1) if wide is not object else np.array([min(range(len(r)), key=r.__getitem__) for r in d])
        entry[a : a + BLOCK] = k
        dist.append(d[np.arange(len(own)), k])
    return entry, (np.concatenate(dist) if dist else np.zeros(0)).astype(object if wide is object else np.int64)


class Members:
    """Members of an owner: position, entry and integers of each."""

    def __init__(self, position: np.ndarray, entry: np.ndarray, rows: np.ndarray):
        self.position, self.entry, self.rows = position.astype(np.uint8), entry.astype(np.uint8), rows

    def take(self, at: np.ndarray) -> Members:
        return Members(self.position[at], self.entry[at], self.rows[at])

    def judged(self, books: list[np.ndarray]) -> np.ndarray:
        """The nearest entry of each."""
        new = np.zeros(len(self.rows), np.int64)
        for p, book in enumerate(books):
            if len(at := np.flatnonzero(self.position == p)):
                new[at] = nearest(self.rows[at], book)[0]
        return new

    def sums(self) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        """(number of the entry, (members, sum of their integers))."""
        key = self.position.astype(np.int64) * ENTRIES + self.entry
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        if len(starts):
            wide = self.rows[order] if self.rows.dtype == object else self.rows[order].astype(np.int64)
            totals = np.add.reduceat(wide, starts, axis=0).astype(object)  # Python's integers: no sum is too large
            for k, a, b, t in zip(key[order][starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(key)], totals, strict=True):
                yield k, (b - a, t)


def merged(parts: list[Members]) -> Members:
    return Members(*(np.concatenate([getattr(m, f) for m in parts]) for f in ("position", "entry", "rows")))


def dealt(members: Members, owner: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The members by owner, packed."""
    order = np.argsort(owner, kind="stable")
    starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(owner)][: len(starts)], strict=True):
        yield int(owner[order[a]]), pickle.dumps(members.take(order[a:b]), 5)


def whole(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, list[np.ndarray]]:
    """The rows that take part, and the first codebooks: the parts of the ENTRIES smallest ids."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    by = [F.col(id_col).asc_nulls_last(), F.col(vector)]
    one = kept.orderBy(*by).select(F.size(vector).alias("n")).limit(1).collect()
    if not one:
        return kept, []
    kept = kept.where(F.size(vector) == one[0].n)
    first = kept.orderBy(*by).select(vector).limit(ENTRIES).collect()  # ENTRIES rows
    return kept, parts_of(integers(np.array([r[0] for r in first], float)))


def parts_of(rows: np.ndarray) -> list[np.ndarray]:
    width = -(-rows.shape[1] // PARTS)
    rows = np.concatenate([rows, np.zeros((len(rows), PARTS * width - rows.shape[1]), rows.dtype)], axis=1)
    return [rows[:, p * width : (p + 1) * width] for p in range(PARTS)]


def batch_rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    return integers(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, 1), np.int16)


def train(kept: DataFrame, books: list[np.ndarray], vector: str = "embedding", rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many rounds over all rows of kept."""
    spark = kept.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))
    owners = max(sc.defaultParallelism, -(-PARTS * kept.count() // OWNER_MEMBERS))
    first = sc.broadcast(books)

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in batches:
            rows = parts_of(batch_rows(batch, 0))
            members = merged([Members(np.full(len(r), p), nearest(r, first.value[p])[0], r) for p, r in enumerate(rows)])
            salts = (salt + np.arange(len(members.rows))) % owners
            salt += len(salts)
            got = list(dealt(members, ((members.position.astype(np.int64) * ENTRIES + members.entry) * SPREAD + salts) % owners))
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in got], pa.int32()), pa.array([m for _, m in got], pa.binary())], names=["owner", "members"])

    start = kept.select(vector).mapInArrow(laid_out, "owner int, members binary").rdd.map(lambda r: (r.owner, bytes(r.members)))
    resident: RDD = at_owners(start, owners)
    held = None
    for k in range(rounds):
        if k:
            judged = resident.mapPartitionsWithIndex(judge(sc.broadcast(books), owners), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            stay = judged.filter(stays).map(plain, preservesPartitioning=True)
            resident = stay.union(at_owners(judged.filter(moves).map(plain), owners))
        else:
            resident = judged = resident.persist(StorageLevel.MEMORY_AND_DISK)
        if k % CHECKPOINT_ROUNDS == 0:
            resident.checkpoint()
        totals = dict(resident.mapPartitions(owner_sums).reduceByKey(added).collect())  # PARTS * ENTRIES rows at most
        books = [np.array([[int(s) // totals[p * ENTRIES + e][0] for s in totals[p * ENTRIES + e][1]] if p * ENTRIES + e in totals else book[e].tolist() for e in range(len(book))], object) for p, book in enumerate(books)]
        books = [narrow(b) for b in books]
        if held is not None:
            held.unpersist()
        held = judged
    if held is not None:
        held.unpersist()
    return books


def narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(v) < 2**62 for v in book.ravel().tolist()) else book


def at_owners(rdd: RDD, owners: int) -> RDD:
    return rdd.partitionBy(owners, owner_number)


def owner_number(owner: int) -> int:
    return owner


def judge(books, owners: int):
    """Residents of an owner with their new entries: those it keeps as (owner, members, True), those that go as (owner, members, False)."""

    def run(owner: int, residents: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes, bool]]:
        packed = [pickle.loads(m) for _, m in residents]
        if not packed:
            return
        members = merged(packed)
        new = members.judged(books.value)
        to = (owner + (new - members.entry) * SPREAD) % owners  # the salt stays
        members.entry = new.astype(np.uint8)
        keep = to == owner
        yield owner, pickle.dumps(members.take(keep), 5), True
        yield from ((o, m, False) for o, m in dealt(members.take(~keep), to[~keep]))

    return run


def stays(x: tuple) -> bool:
    return x[2]


def moves(x: tuple) -> bool:
    return not x[2]


def plain(x: tuple) -> tuple[int, bytes]:
    return x[0], x[1]


def owner_sums(residents: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
    for _, m in residents:
        yield from pickle.loads(m).sums()


def added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def encode(kept: DataFrame, books: list[np.ndarray], vector: str = "embedding") -> DataFrame:
    """kept with code (two hex digits a part) and error (squared distances summed over parts) instead of the vector."""
    shared, others = kept.sparkSession.sparkContext.broadcast(books), [c for c in kept.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(r, book) for r, book in zip(parts_of(batch_rows(batch, len(others))), shared.value, strict=True)]
            codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            errors = [min(int(e), LARGEST) for e in sum(d.astype(object) for _, d in found)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), pa.array([codes[2 * PARTS * k : 2 * PARTS * (k + 1)] for k in range(batch.num_rows)], pa.string()), pa.array(errors, pa.int64())], names=[*others, "code", "error"])

    own = kept.select(*[F.col(f"`{c}`") for c in others], vector)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != vector)
    return own.mapInArrow(run, f"{schema}, code string, error bigint")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: error summed over all rows of an equal label, nulls together."""
    spark = coded.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    sums = coded.groupBy(key.alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    few = sums.limit(MOST_LABELS + 1).collect()
    if len(few) <= MOST_LABELS:
        return coded.withColumn("__label", key).join(F.broadcast(spark.createDataFrame(few, sums.schema)), "__label").drop("__label")
    return salted_join(coded.withColumn("__label", key), sums, ["__label"], F.struct("vec_id", "code")).drop("__label")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector that takes part: vec_id, code, error, label_error, codebooks_sha256."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    kept, books = whole(vectors)
    if books:
        books = train(kept, books)
    coded = staged(encode(kept, books), "vector-codes") if books else spark.createDataFrame([], "vec_id bigint, label int, code string, error bigint")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_sql() -> str:
    """The same for DuckDB: each round as two steps, distances to all entries and means by component."""
    near = """n{k} AS MATERIALIZED (SELECT id, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT s.id, s.p, b.e, s.v2 - 2 * list_inner_product(s.v, b.v) + list_inner_product(b.v, b.v) AS d
  FROM parts s JOIN b{k} b ON s.p = b.p) GROUP BY id, p)"""
    mean = """b{n} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.v, o.v) AS v FROM b{k} o LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM (SELECT n.p, n.e, c.i, floor(sum(c.x) / count(*)) AS x
  FROM n{k} n JOIN components c ON n.id = c.id AND n.p = c.p GROUP BY 1, 2, 3) GROUP BY p, e) m ON o.p = m.p AND o.e = m.e)"""
    steps = [s for k in range(ROUNDS) for s in (near.format(k=k), mean.format(k=k, n=k + 1))] + [near.format(k=ROUNDS)]
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, p, v, list_inner_product(v, v) AS v2 FROM (SELECT id, CAST(p AS INT) AS p, q[len(q) // 4 * p + 1 : len(q) // 4 * (p + 1)] AS v FROM kept, range(4) t(p))),
components AS MATERIALIZED (SELECT id, p, unnest(range(len(v))) AS i, unnest(v) AS x FROM parts),
b0 AS MATERIALIZED (SELECT p, CAST(id - 1 AS INT) AS e, v FROM parts WHERE id <= 256),
{", ".join(steps)},
codes AS (SELECT id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY id),
books AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(range(len(v))) AS i, unnest(v) AS x FROM b{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (id), books"""


OP13_SQL = op13_sql()
