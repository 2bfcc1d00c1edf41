"""Op 11: documents packed into sequences by patterns of few lengths, fitted to the histogram of lengths.

Tokens: a document's ids by the tokenizers library and an end id. A longer document than a sequence is cut into pieces of a
whole sequence; its first piece takes what is left over.

Plan: it follows from the histogram of lengths alone, which has one number a length whatever the corpus. All patterns of at
most three lengths that fill a sequence exactly are enumerated; non-negative least squares (multiplicative updates, a count's
difference in units of its root) fits how often each is repeated; repeats are rounded with the error carried on to
the next pattern, never beyond the pieces left; what remains is packed by best fit decreasing, on counts again. Where few
lengths occur, hardly any three fill a sequence, and a smaller share of the fit leaves more to best fit: SHARES are tried. The result is a table of slots: the pieces of one length with ranks from `first` on go to sequence `sequence + r div each`.

Placing: pieces are written once with their number among the task's pieces of that length. Counts by length and task, summed
before the shuffle, give each piece its rank; the slots, bounded by the number of patterns, are broadcast.

Defined results: a null or empty text is its end id alone; a null doc_id is kept as null; repeated rows are packed each on
its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, staged, text_chunks
from .token_store import END_ID, encoder

CAPACITY, MOST_PARTS = 1024, 3
#: Rounds of the fit, and most patterns enumerated (a wider sequence takes every k-th smallest length of a triple only).
FIT_ROUNDS, MOST_PATTERNS = 400, 200_000
#: Shares of the fitted repeats that are tried; the one of fewest sequences is taken, the largest of equals.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, and first what is left over."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids (little-endian unsigned 32-bit), task and no: which one of the task's pieces of this length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, task, seen = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for part, texts in text_chunks(batch, "text"):
                at, cols = [], ([], [], [], [], [])
                for row, own in enumerate(encode([(t or b"").decode() for t in texts])):
                    own += end
                    for k, (start, length) in enumerate(cut(len(own) // 4, capacity)):
                        at.append(row)
                        for c, v in zip(cols, (k, start, length, own[4 * start : 4 * (start + length)], seen[length]), strict=True):
                            c.append(v)
                        seen[length] += 1
                k, start, length, ids, no = cols
                arrays = [part.column(0).take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(at), pa.int32()), pa.array(no, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids", "task", "no"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary, task int, no bigint")


def patterns(there: np.ndarray, capacity: int, most: int = MOST_PATTERNS) -> np.ndarray:
    """All ascending triples of lengths in `there` (booleans by length) that sum to capacity; a leading 0 stands for no piece."""
    lengths = np.flatnonzero(there)
    lengths = lengths[lengths > 0]
    smallest = lengths[lengths <= capacity // 3]
    step = max(1, -(-len(smallest) * len(lengths) // (4 * most)))
    out = [np.array([[0, 0, capacity]])] if there[capacity] else []
    for a in [0, *smallest[::step].tolist()]:
        b = lengths[(lengths >= a) & (2 * lengths <= capacity - a)]
        c = capacity - a - b
        ok = there[c]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out).astype(np.int64).reshape(-1, 3) if out else np.zeros((0, 3), np.int64)


def fit(table: np.ndarray, counts: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Repeats x >= 0 of each pattern (row of three lengths) that minimise the squared difference to the counts, each in units of its root.

    Multiplicative updates for least squares: they keep x above zero and never raise the error.
    """
    n = len(counts)
    weight = 1 / np.maximum(counts, 1)
    weight[0] = 0
    flat = table.T.ravel()
    cover = lambda x: np.bincount(flat, np.tile(x, 3), n)
    back = lambda r: r[table[:, 0]] + r[table[:, 1]] + r[table[:, 2]]
    wanted, x = back(weight * counts), np.full(len(table), counts.sum() / (2 * len(table)))
    for _ in range(rounds):
        x = x * wanted / np.maximum(back(weight * cover(x)), 1e-300)
    return x


def rounded(x: np.ndarray, table: np.ndarray, left: np.ndarray) -> list[tuple[tuple, int]]:
    """Whole repeats, the error of each carried on to the next; takes the pieces from `left`, never more than there are."""
    out, carry = [], 0.0
    for k in np.flatnonzero(x > 1e-9).tolist():
        carry += x[k]
        if carry < 0.5:
            continue
        layout = [(int(a), 1) for a in table[k] if a]
        need = defaultdict(int)
        for a, _ in layout:
            need[a] += 1
        n = min(int(carry + 0.5), *(int(left[a]) // m for a, m in need.items()))
        carry -= int(carry + 0.5)
        if n > 0:
            for a, m in need.items():
                left[a] -= n * m
            out.append((tuple(layout), n))
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best fit decreasing on counts: (layout, number of sequences with it); a layout is a tuple of (length, pieces of it)."""
    open_: dict[int, list] = defaultdict(list)
    for length in range(capacity, 0, -1):
        c = int(left[length])
        while c:
            free = next((f for f in range(length, capacity + 1) if open_[f]), None)
            layout, n = open_[free].pop() if free else ((), c)
            free = free or capacity
            k = free // length
            if full := min(n, c // k):
                open_[free - k * length].append(((*layout, (length, k)), full))
                c, n = c - full * k, n - full
            if n and c:
                open_[free - c * length].append(((*layout, (length, c)), 1))
                c, n = 0, n - 1
            if n and layout:
                open_[free].append((layout, n))
    return [x for group in open_.values() for x in group]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """counts by length (index 0 to capacity) -> slots, rows (length, first rank, pieces a sequence, sequence, offset) sorted by length and rank."""
    counts = np.array(counts, np.int64)
    table = patterns(counts > 0, capacity)
    x = fit(table, counts) if len(table) else np.zeros(0)
    tried = []
    for share in SHARES:
        left = counts.copy()
        tried.append(rounded(share * x, table, left) + best_fit(left, capacity))
    layouts = min(tried, key=lambda t: sum(n for _, n in t))
    used, sequence, slots = defaultdict(int), 0, []
    for layout, n in layouts:
        offset = 0
        for length, each in layout:
            slots.append((length, used[length], each, sequence, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written pieces (length, task, no and other columns) with sequence_id and offset instead of task and no."""
    spark = parts.sparkSession
    counts = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        histogram[r.length] = r.n
    slots = spark.sparkContext.broadcast(plan(histogram, capacity))  # bounded by the number of patterns
    ranked = parts.join(ahead.select("length", "task", "ahead"), ["length", "task"]).withColumn("rank", F.col("no") + F.col("ahead")).drop("task", "no", "ahead")
    kept = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("rank", "length"))
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            r, each = rank - table[k, 1], table[k, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(table[k, 3] + r // each), pa.array(table[k, 4] + r % each * length)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def sequences(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (as in pieces) and documents, a struct (doc_id, piece, offset, length) for each piece."""
    placed = place(parts, capacity).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("p"))  # capacity tokens at most
    ids = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    return placed.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("documents"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece: doc_id, piece, start, length, ids_crc32 (of its written ids), sequence_id, offset."""
    import public_tokenizers

    parts = staged(pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    digests = parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "no")
    return place(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
