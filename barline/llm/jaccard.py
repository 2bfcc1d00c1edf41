"""Op 2: Jaccard join on word shingles, by rare-first prefixes with length, positional and suffix filters.

1. Counts: every text's distinct shingles are counted by cell (a hash), first within a task, then by bucket. What comes back
   has a fixed size: a bitmap of cells seen more than once, and the counts of the HEAVY most frequent cells. They fix one total
   order, rare first. (Any total order gives all links; the counts only make it a good one.)
2. Postings: a text's prefix in that order, without shingles seen once, as (shingle, class, size, position). A class is a
   set of shingles: exact copies collapse there. Frequent shingles are dealt over several groups.
3. Candidates, first round: in each group the class with the smallest position is the hub; the others pair with it, if size
   and position allow the threshold (length and positional filters). This is linear in the postings.
4. Verification: pairs are made distinct, their sizes by hash range are compared (suffix filter: shares that differ too
   much cannot overlap enough), and the sets themselves are intersected, once a pair.
5. Second round: classes that share a prefix shingle but are not yet in one component are paired with each other, filtered
   and verified alike. A shingle of more than BLOCK_CLASSES such classes is dealt over blocks, where a large component has
   blocks of its own: two blocks of one component are never joined. Pairs inside a component cannot change it. So all components are exact,
   without all pairs of a group.

Defined results: null, empty and blank texts have no shingles and link with nothing; rows of one doc_id are one document
(its texts are linked); rows with a null doc_id get the smallest doc_id they reach, or null. Sets of equal 128-bit hash are
taken for equal sets. Postings name a class by the first half of that hash; classes that share it are told apart before they are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Members, read, salted_join, staged, text_chunks, trimmed
from .components import connected_components
from .shingles import shingle_sets

#: Fixed sizes of what the counts send back: bits of the seen-twice map, and frequent cells kept with their counts.
BITMAP_BITS, HEAVY, HEAVY_LEAST = 1 << 26, 1 << 17, 8
#: Postings of a shingle that one group holds, about.
GROUP_POSTINGS = 20_000
#: Classes of a shingle in one block of the second round.
BLOCK_CLASSES = 500
FLUSH_TOKENS, SLICE_BYTES = 1 << 21, 1 << 20
BUCKET_BYTES = 64 << 20
RANGES = 16


def needed(na, nb):
    """The least overlap of linked sets: 100 * i >= 80 * (na + nb - i)."""
    return (4 * (na + nb) + 8) // 9


def bucket_number(docs: DataFrame, text: str) -> int:
    """Buckets for tables of shingles: they grow with the corpus, twice the shuffle partitions at least."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`").cast("string"))), F.lit(0))).first()[0]
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


class Order:
    """Bits and counts by cell: what is known of a shingle's frequency."""

    def __init__(self, buckets: int, bits: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.buckets, self.bits, self.keys, self.counts = buckets, bits, keys, counts
        self.width = len(bits) * 8 // buckets

    def weights(self, h: np.ndarray) -> np.ndarray:
        """0: seen once; 1: more often; larger: the count of a frequent cell."""
        bucket, cell = h % np.uint64(self.buckets), h >> np.uint64(32)
        at = (bucket * np.uint64(self.width) + cell % np.uint64(self.width)).astype(np.int64)
        out = ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64)
        twice = np.flatnonzero(out)
        if len(self.keys) and len(twice):
            key = (bucket[twice] << np.uint64(32)) | cell[twice]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[twice] = np.where(self.keys[k] == key, self.counts[k], 1)
        return out


def count_shingles(docs: DataFrame, text: str = "text") -> Order:
    buckets = bucket_number(docs, text)
    width = max(8, BITMAP_BITS // buckets // 8 * 8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            h = np.concatenate(held)
            place, counts = np.unique((h % np.uint64(buckets)) << np.uint64(32) | h >> np.uint64(32), return_counts=True)
            bucket = (place >> np.uint64(32)).astype(np.int32)
            cells = np.empty(len(place), CELL)
            cells["cell"], cells["n"] = place & np.uint64(0xFFFFFFFF), counts
            edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            ones, more = [], []
            for a, b in zip(edges, [*edges[1:], len(cells)], strict=True):
                part, once = cells[a:b], counts[a:b] == 1
                ones.append(part["cell"][once].tobytes())
                more.append(part[~once].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges]), pa.array(ones, pa.binary()), pa.array(more, pa.binary())], names=["bucket", "ones", "more"])

        for batch in batches:
            for _, texts in text_chunks(batch, "t", SLICE_BYTES):
                sets = shingle_sets(texts)
                held += sets
                n += sum(map(len, sets))
                if n >= FLUSH_TOKENS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame.bucket.iloc[0])
        ones, more = np.frombuffer(b"".join(frame.ones), "<u4"), np.frombuffer(b"".join(frame.more), CELL)
        cells, counts = np.concatenate([ones, more["cell"]]), np.concatenate([np.ones(len(ones), np.int64), more["n"].astype(np.int64)])
        order = np.argsort(cells, kind="stable")
        cells, first = cells[order], np.flatnonzero(np.diff(cells[order].astype(np.int64), prepend=-1))
        cells, counts = cells[first], np.add.reduceat(counts[order], first)
        bits = np.zeros(width, bool)
        bits[cells[counts > 1] % width] = True
        heavy = np.flatnonzero(counts >= HEAVY_LEAST)
        heavy = heavy[np.argsort(-counts[heavy], kind="stable")[:HEAVY]]  # no more than HEAVY of all can come from one bucket
        return pd.DataFrame({"bucket": [bucket], "bits": [np.packbits(bits, bitorder="little").tobytes()], "cells": [cells[heavy].astype(np.int64)], "counts": [counts[heavy]]})

    packed = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(lambda batches: trimmed(pack(batches)), "bucket int, ones binary, more binary")
    found = staged(packed.groupBy("bucket").applyInPandas(count, "bucket int, bits binary, cells array<bigint>, counts array<bigint>"), "shingle-counts")
    bits = np.zeros(buckets * width // 8, np.uint8)
    for r in found.select("bucket", "bits").collect():  # BITMAP_BITS in all
        bits[r.bucket * width // 8 : (r.bucket + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    top = found.select("bucket", F.explode(F.arrays_zip("cells", "counts")).alias("x")).select((F.shiftleft(F.col("bucket").cast("bigint"), 32) + F.col("x.cells")).alias("key"), F.col("x.counts").alias("n"))
    top = top.orderBy(F.desc("n"), "key").limit(HEAVY).toArrow()
    keys, counts = top.column("key").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(keys)
    return Order(buckets, bits, keys[order], counts[order])


CELL = np.dtype([("cell", "<u4"), ("n", "<u4")])
POSTING = np.dtype([("token", "<u8"), ("key", "<i8"), ("n", "<i4"), ("position", "<i4"), ("salt", "<i4")])
ENTRY = "kind int, doc_id bigint, key bigint, key2 bigint, n bigint, ranges array<int>, bucket int, postings binary"


def set_key(h: np.ndarray) -> tuple[int, int]:
    """Both halves of a 128-bit hash of a set."""
    digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def index_texts(docs: DataFrame, order: Order, text: str, id_col: str) -> DataFrame:
    """kind 0: a row for each text (doc_id, n, key of its set, sizes by hash range); kind 1: packed postings by bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # BITMAP_BITS and HEAVY bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held, n_held = [], 0

        def info(ids, keys, keys2, sizes, ranges):
            k = len(keys)
            none = pa.nulls(k)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), ids, pa.array(keys, pa.int64()), pa.array(keys2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), none.cast(pa.int32()), none.cast(pa.binary())], names=names)

        def flush():
            p = np.concatenate(held)
            bucket = ((p["token"] + p["salt"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(own.buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            p, bucket = p[by], bucket[by]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            parts = [p[a:b].tobytes() for a, b in zip(edges.tolist(), [*edges.tolist()[1:], len(p)], strict=True)]
            none = pa.nulls(len(parts))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(parts), np.int32)), *[none.cast(pa.int64())] * 4, none.cast(pa.list_(pa.int32())), pa.array(bucket[edges]), pa.array(parts, pa.binary())], names=names)

        names = ["kind", "doc_id", "key", "key2", "n", "ranges", "bucket", "postings"]
        for batch in batches:
            for part, texts in text_chunks(batch, "t", SLICE_BYTES):
                sets = shingle_sets(texts)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                weights = own.weights(every)
                salts = np.maximum(1, -(-weights // GROUP_POSTINGS))
                keys, keys2, sizes, ranges, at = [], [], [], [], 0
                for h in sets:
                    n = len(h)
                    w = weights[at : at + n]
                    own_key = set_key(h) if n else (None, None)
                    keys.append(own_key[0])
                    keys2.append(own_key[1])
                    sizes.append(n)
                    ranges.append(np.bincount((h >> np.uint64(60)).astype(np.int64), minlength=RANGES).astype(np.int32) if n else [0] * RANGES)
                    if n:
                        prefix = np.argsort(w, kind="stable")[: n - (4 * n + 4) // 5 + 1]
                        position = np.flatnonzero(w[prefix] > 0)
                        if len(position):
                            p = np.empty(len(position), POSTING)
                            took = prefix[position]
                            salt = salts[at + took]
                            p["token"], p["key"], p["n"], p["position"] = h[took], keys[-1], n, position
                            p["salt"] = np.where(salt > 1, 1 + (keys[-1] & 0xFFFFFFFF) % salt, 0)
                            held.append(p)
                            n_held += len(p)
                    at += n
                yield info(part.column(0), keys, keys2, sizes, ranges)
                if n_held >= FLUSH_TOKENS // 4:
                    yield flush()
                    held, n_held = [], 0
        if n_held:
            yield flush()

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(lambda batches: trimmed(run(batches)), ENTRY)


def hub_pairs(postings: DataFrame) -> DataFrame:
    """From packed postings: rows (a, b) of hub pairs that pass the filters, and rows with members of groups that may have more links."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p = np.frombuffer(b"".join(frame.postings), POSTING)
        p = p[np.lexsort((p["key"], p["n"], p["position"], p["salt"], p["token"]))]
        group = (p["token"][1:] == p["token"][:-1]) & (p["salt"][1:] == p["salt"][:-1])
        p = p[np.concatenate([[True], ~(group & (p["key"][1:] == p["key"][:-1]) & (p["n"][1:] == p["n"][:-1]) & (p["position"][1:] == p["position"][:-1]))])]
        first = np.flatnonzero(np.concatenate([[True], (p["token"][1:] != p["token"][:-1]) | (p["salt"][1:] != p["salt"][:-1])]))
        size = np.diff(np.append(first, len(p)))
        hub = np.repeat(first, size)
        member = np.arange(len(p))
        n, m, i, j = p["n"][hub].astype(np.int64), p["n"].astype(np.int64), p["position"][hub], p["position"]
        ok = (hub != member) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (1 + np.minimum(n - i - 1, m - j - 1) >= needed(n, m))
        a, b = p["key"][hub[ok]], p["key"][ok]
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        rows = np.repeat((size >= 3) | (p["salt"][first] > 0), size)
        q, leads = p[rows], (hub == member)[rows] & (p["salt"][rows] > 0)
        none = lambda k: pd.array([None] * k, "Int64")
        return pd.concat([
            pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "token": none(len(pairs)), "n": none(len(pairs)), "position": none(len(pairs)), "leads": False}),
            pd.DataFrame({"a": q["key"], "b": none(len(q)), "token": pd.array(q["token"].view("<i8"), "Int64"), "n": pd.array(q["n"], "Int64"), "position": pd.array(q["position"], "Int64"), "leads": leads}),
        ])

    return postings.groupBy("bucket").applyInPandas(run, "a bigint, b bigint, token bigint, n bigint, position bigint, leads boolean")


def near_range_sizes(a: str, b: str, both: F.Column | None = None) -> F.Column:
    """Suffix filter: sets whose sizes by hash range differ too much cannot overlap enough. both: the sum of their sizes."""
    both = F.col("na") + F.col("nb") if both is None else both
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return apart <= both - 2 * F.floor((4 * both + 8) / 9)


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """The distinct pairs of classes (a, b) whose sets are linked, with their overlap. Texts are read once, and only those of candidate pairs become sets."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("ranges").alias(f"r{c}"), F.col("rep").alias(f"rep{c}"), F.struct("key", "key2").alias(f"k{c}"))
    near = pairs.select("a", "b").where("a <> b").distinct().join(side("a"), "a").join(side("b"), "b").where(near_range_sizes("ra", "rb")).drop("ra", "rb")
    near = staged(near, "near-pairs")
    reps = near.select(F.col("repa").alias("rep"), F.col("ka").alias("k")).unionAll(near.select("repb", "kb")).distinct()
    chosen = Members(reps.select(F.xxhash64("rep").alias("h")))
    wanted = Members(reps.select(F.col("k.key2").alias("h")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(chosen.test(batch.column(0).to_numpy())))
            for part, texts in text_chunks(batch, "t", SLICE_BYTES):
                own = shingle_sets(texts)
                keys = [set_key(h) if len(h) else (None, 0) for h in own]
                kept = wanted.test(np.array([k[1] for k in keys], np.int64)) & np.array([k[0] is not None for k in keys], bool) if keys else np.zeros(0, bool)
                own, keys = [h for h, k in zip(own, kept, strict=True) if k], [x for x, k in zip(keys, kept, strict=True) if k]
                flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(h) for h in own])]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(1).filter(pa.array(kept)), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), hashes], names=["doc", "key", "key2", "hashes"])

    made = docs.select(F.xxhash64(F.col(f"`{id_col}`").cast("bigint")).alias("h"), F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text}`").cast("string").alias("t"))
    made = staged(made.mapInArrow(lambda batches: trimmed(sets(batches)), "doc bigint, key bigint, key2 bigint, hashes array<bigint>"), "sets")
    both = near
    for c in "ba":
        own = made.select(F.struct("key", "key2").alias("k"), F.col("doc"), F.col("hashes").alias(f"h{c}"))
        both = both.join(own, (F.col("k") == F.col(f"k{c}")) & F.col("doc").eqNullSafe(F.col(f"rep{c}"))).drop("k", "doc")
    sized = both.select("a", "b", F.size("ha").alias("x"), F.size("hb").alias("y"), F.size(F.array_intersect("ha", "hb")).alias("overlap"))
    return sized.where("100 * overlap >= 80 * (x + y - overlap)").select("a", "b", "overlap").distinct()


def name_classes(info: DataFrame) -> tuple[DataFrame, bool]:
    """A row for each set: key, key2, id, rep (its smallest doc_id), n, ranges; and whether sets share a key.

    id is the key, or the second half of the hash for all but one of the sets that share a key.
    """
    sets = staged(info.where("n > 0").groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("ranges").alias("ranges")), "classes")
    shared = sets.groupBy("key").agg(F.min("key2").alias("first"), F.count("*").alias("sets")).where("sets > 1").select("key", "first")
    if shared.isEmpty():
        return sets.withColumn("id", F.col("key")), False
    return staged(sets.join(shared, "key", "left").withColumn("id", F.when(F.col("key2") == F.coalesce("first", "key2"), F.col("key")).otherwise(F.col("key2"))).drop("first"), "class-names"), True


def open_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Second round: pairs (a, b) of classes of different roots that share a shingle and pass the filters. members: token, id, n, position, root."""
    mixed = members.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("total")).where("x <> y").select("token", "total")
    rows = salted_join(members, mixed, ["token"], F.col("id")).join(classes.select("id", "ranges"), "id")
    rows = staged(rows.withColumn("whole", F.col("total") <= BLOCK_CLASSES), "open-members")
    own = ["id", "n", "position", "root", "ranges"]
    side = lambda df, s, keys: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in own])
    fits = (
        (F.col("root_a") != F.col("root_b")) & (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
        & (9 * (1 + F.least(F.col("n_a") - F.col("position_a") - 1, F.col("n_b") - F.col("position_b") - 1)) >= 4 * (F.col("n_a") + F.col("n_b")))
    )
    near = near_range_sizes("ranges_a", "ranges_b", F.col("n_a") + F.col("n_b"))
    small = rows.where("whole")
    found = side(small, "a", ["token"]).join(side(small, "b", ["token"]), "token").where((F.col("id_a") < F.col("id_b")) & fits & near).select("id_a", "id_b")

    large = rows.where("NOT whole")
    if not large.isEmpty():
        sizes = large.groupBy("token", "root").agg(F.count("*").alias("c"))
        few = sizes.where(F.col("c") < BLOCK_CLASSES).groupBy("token").agg(F.sum("c").alias("few"))
        plan = sizes.join(few, "token", "left").select("token", "root", *[F.when(F.col("c") >= BLOCK_CLASSES, big).otherwise(little).alias(name) for name, big, little in (
            ("of", F.col("root"), F.lit(None)), ("blocks", F.ceil(F.col("c") / BLOCK_CLASSES), F.ceil(F.col("few") / BLOCK_CLASSES)))])
        plan = staged(plan.withColumn("own", F.col("of").isNotNull()).withColumn("of", F.coalesce("of", F.lit(0))), "open-plan")
        dealt = salted_join(large, plan, ["token", "root"], F.col("id"))
        dealt = dealt.withColumn("block", F.struct("own", "of", F.pmod(F.xxhash64(F.when(F.col("own"), F.col("id")).otherwise(F.col("root"))), F.col("blocks")).alias("k")))
        listed = plan.select("token", "own", "of", "blocks").distinct().select("token", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: F.struct(F.col("own"), F.col("of"), k.alias("k")))).alias("block"))
        other = listed.select("token", F.col("block").alias("other"))
        alike = (F.col("block.own") & F.col("other.own") & (F.col("block.of") == F.col("other.of")))
        pairs = staged(listed.join(other, "token").where((F.col("block") <= F.col("other")) & ~alike).select("token", F.col("block").alias("x"), F.col("other").alias("y")), "open-blocks")
        halves = [side(salted_join(dealt, pairs.withColumn("block", F.col(at)), ["token", "block"], F.col("id")), s, ["token", "x", "y"]) for at, s in (("x", "a"), ("y", "b"))]
        once = (F.col("x") < F.col("y")) | (F.col("id_a") < F.col("id_b"))
        found = found.unionAll(halves[0].join(halves[1], ["token", "x", "y"]).where(once & fits & near).select("id_a", "id_b"))
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    entries = staged(index_texts(docs, count_shingles(docs, text), text, id_col), "entries")
    info = entries.where("kind = 0").select("doc_id", "key", "key2", "n", "ranges")
    classes, clash = name_classes(info)
    groups = staged(hub_pairs(entries.where("kind = 1").select("bucket", "postings")), "groups")

    leads = groups.where("leads").select("token", "a", "n", "position")
    top = leads.groupBy("token").agg(F.min(F.struct("position", "n", "a")).alias("top"))
    across = leads.join(top, "token").where("a <> top.a").select(F.col("top.a").alias("a"), F.col("a").alias("b"))
    tried = groups.where("token IS NULL").select("a", "b").unionAll(across)
    members = groups.where("token IS NOT NULL").select("token", F.col("a").alias("key"), "n", "position")
    if clash:  # a key then stands for several classes: all of them are candidates, and so are they for each other
        for c in "ab":
            tried = tried.join(classes.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id")), c)
        one, two = (classes.select("key", F.col("id").alias(c)) for c in ("a", "b"))
        tried = tried.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionAll(one.join(two, "key").select("a", "b"))
        members = members.join(classes.select("key", "n", "id"), ["key", "n"]).drop("key")
    else:
        members = members.withColumnRenamed("key", "id")
    tried = tried.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    first = staged(verify(tried, classes, docs, text, id_col).select("a", "b"), "links")
    # rows of one doc_id are one document
    texts = info.where("key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.struct("key", "key2").alias("k"))
    several = texts.groupBy("doc_id").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x <> y").select("doc_id", "x")
    several = texts.join(several, "doc_id").where("x <> k").select("x", "k").distinct()
    name = lambda c, out: classes.select(F.struct("key", "key2").alias(c), F.col("id").alias(out))
    links = first.unionAll(several.join(name("x", "a"), "x").join(name("k", "b"), "k").select("a", "b"))
    found = staged(connected_components(links), "components")

    known = members.join(found.select(F.col("node").alias("id"), "root"), "id", "left").select("token", "id", "n", "position", F.coalesce("root", "id").alias("root"))
    rest = open_pairs(staged(known, "members"), classes)
    second = verify(rest.join(tried.distinct(), ["a", "b"], "left_anti"), classes, docs, text, id_col).select("a", "b")
    found = connected_components(staged(links.unionAll(second), "all-links"))

    top = classes.join(found.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "key2", "rep", F.coalesce("root", "id").alias("root"))
    least = top.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = salted_join(top, least, ["root"], F.col("key")).select("key", "key2", "component_id")
    out = salted_join(info, named, ["key", "key2"], F.col("doc_id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the component's id (rows without an id, and texts without shingles, all stay).

    Texts are not shuffled for this: a bitmap of bounded size tells which ids may have to go, and only those rows are joined.
    """
    found = staged(near_duplicates(docs), "near-duplicates").where("doc_id IS NOT NULL")
    by_id = found.groupBy(F.col("doc_id").alias("__id")).agg(F.min("component_id").alias("__component"), F.count("*").alias("__rows"))
    by_id = staged(by_id.where("__component < __id OR __rows > 1"), "ids-to-judge")
    chosen = Members(by_id.select(F.xxhash64("__id").alias("h")))

    own = [F.col(f"`{c}`") for c in docs.columns]
    maybe = chosen.column(F.xxhash64(F.col("doc_id").cast("bigint")))
    joined = docs.where(maybe).join(by_id.hint("merge"), F.col("doc_id") == F.col("__id"), "left")
    once = joined.where("__id IS NULL OR (__component = __id AND __rows = 1)").select(*own)
    repeated = joined.where("__component = __id AND __rows > 1").withColumn("__k", F.row_number().over(Window.partitionBy("__id").orderBy("text"))).where("__k = 1").select(*own)
    return docs.where(~maybe).unionByName(once).unionByName(repeated)


#: For tables of one row a doc_id.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
