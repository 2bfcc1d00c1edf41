"""Op 9: benchmark decontamination by Wu-Manber multi-pattern search.

Texts become words of digits, letters a-z (A-Z lowered) and bytes from 0x80, joined by single blanks, with a blank at
both ends. A pattern is the same form of a window: 13 consecutive words of an item, or all of an item of fewer. The
patterns go by length into classes, so that a short item does not shorten the shifts of the long ones. For each class a
shift table says how far a block of text lets the search jump; where it says 0, the block's hash selects the patterns
whose first `length` bytes end in it, and direct comparison confirms. All documents of a batch are searched in
lockstep: one numpy step moves the cursor of every stretch of text.

Defined results: null and empty texts have no words, no hits and are not contaminated; items without words have no
window; equal items count each under their own id, rows of one item_id count once, rows with a null item_id are left out;
repeated documents each get a row; very long texts are searched whole, in stretches side by side.
"""

from __future__ import annotations

import uuid
from array import array
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, field, read, staged

WINDOW = 13
#: Bytes of item text that are compiled and sent to the executors at a time; larger benchmarks take a job each.
BLOCK_BYTES = 8 << 20
#: Bits of a table's index, and the longest jump that it holds (a shorter one is right too): a byte an entry.
SHIFT_BITS, MOST_SHIFT = 20, 255
STRETCH = 4096
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: bytes | None) -> tuple[bytes, int]:
    """Words joined and surrounded by single blanks, and their number."""
    words = (text or b"").translate(LOWER).split()
    return (b" " + b" ".join(words) + b" " if words else b""), len(words)


def windows(text: bytes | None) -> list[bytes]:
    words = (text or b"").translate(LOWER).split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(max(1, len(words) - WINDOW + 1))] if words else []


def _block_hash(buffer: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """Hash of the `block` bytes that end just before each of ends."""
    h = np.zeros(len(ends), np.uint64)
    for k in range(block, 0, -1):
        h = h * np.uint64(0x9E3779B97F4A7C15) + buffer[ends - k]
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SHIFT_BITS)


class WuManber:
    """Shift and bucket tables for patterns that have at least `length` bytes each."""

    def __init__(self, patterns: list[bytes]):
        self.length = min(map(len, patterns))
        self.block = min(10, max(1, self.length // 3))
        self.shift = np.full(1 << SHIFT_BITS, min(MOST_SHIFT, self.length - self.block + 1), np.uint8)
        self.buckets: dict[int, list[bytes]] = defaultdict(list)
        firsts = np.frombuffer(b"".join(p[: self.length] for p in patterns), np.uint8)
        starts = np.arange(len(patterns)) * self.length
        for end in range(self.block, self.length + 1):
            np.minimum.at(self.shift, _block_hash(firsts, starts + end, self.block), np.uint8(min(MOST_SHIFT, self.length - end)))
        for p, h in zip(patterns, _block_hash(firsts, starts + self.length, self.block).tolist(), strict=True):
            self.buckets[h].append(p)

    def find(self, text: bytes, buffer: np.ndarray, bounds: np.ndarray) -> dict[bytes, array]:
        """The starts of all occurrences in text of each pattern that occurs. bounds: rows of first and last end that a stretch looks at."""
        at, last = bounds[:, 0] + self.length, bounds[:, 1]
        found: dict[bytes, array] = defaultdict(lambda: array("q"))
        live = at <= last
        at, last = at[live], last[live]
        while len(at):
            h = _block_hash(buffer, at, self.block)
            jump = self.shift[h]
            for i in np.flatnonzero(jump == 0).tolist():
                start = int(at[i]) - self.length
                for p in self.buckets.get(int(h[i]), ()):
                    if text.startswith(p, start):
                        found[p].append(start)
            at = at + np.maximum(jump, 1).astype(np.int64)
            live = at <= last
            at, last = at[live], last[live]
        return found


def compile_items(items: list[tuple[object, bytes | None]]) -> tuple[list[WuManber], dict[bytes, list[str]]]:
    """Searchers by length class, and the ids of the items that have each window."""
    owners: dict[bytes, dict[str, None]] = defaultdict(dict)
    for i, text in items:
        for w in dict.fromkeys(windows(text)):
            owners[w][str(i)] = None
    classes: dict[int, list[bytes]] = defaultdict(list)
    for p in owners:
        classes[min(len(p), 48).bit_length() if len(p) < 32 else 6 + (len(p) >= 48)].append(p)
    return [WuManber(ps) for _, ps in sorted(classes.items())], {w: list(ids) for w, ids in owners.items()}


_COMPILED: dict[str, tuple] = {}


def compiled(name: str, items) -> tuple[list[WuManber], dict[bytes, list[str]]]:
    """The searchers of a broadcast block of items, made once in a worker and kept until the next block."""
    if name not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[name] = compile_items(items.value)
    return _COMPILED[name]


def search_batch(searchers: list[WuManber], owners: dict[bytes, list[str]], texts: list) -> list[tuple[int, list[int], list[str]]]:
    """For each text: its number of words, the numbers of the words that are hit, the ids of the items found."""
    forms = [normal(t) for t in texts]
    text = b"".join(x for x, _ in forms)
    sizes = np.array([len(x) for x, _ in forms], np.int64)
    ends = np.cumsum(sizes)
    out: list = [(n, [], []) for _, n in forms]
    if not len(text):
        return out
    buffer = np.frombuffer(text, np.uint8)
    first = np.concatenate([np.arange(e - s, e, STRETCH) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)])
    doc_end = ends[np.searchsorted(ends, first, side="right")]
    hits: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
    for s in searchers:
        bounds = np.stack([first, np.minimum(first + STRETCH - 1 + s.length, doc_end)], axis=1)
        for p, starts in s.find(text, buffer, bounds).items():
            at = np.sort(np.frombuffer(starts, np.int64))
            doc = np.searchsorted(ends, at, side="right")
            inside = at + len(p) <= ends[doc]
            at, doc = at[inside], doc[inside]
            edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1)).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                hits[int(doc[a])][0].append((at[a:b], len(p)))
                hits[int(doc[a])][1].update(owners[p])
    for k, (spans, items) in hits.items():
        a, b = int(ends[k] - sizes[k]), int(ends[k])
        blanks = np.flatnonzero(buffer[a:b] == 32)
        depth = np.zeros(len(blanks) + 1, np.int64)
        for starts, n in spans:
            np.add.at(depth, np.searchsorted(blanks, starts - a), 1)
            np.add.at(depth, np.searchsorted(blanks, starts - a + n - 1), -1)
        out[k] = (out[k][0], np.flatnonzero(np.cumsum(depth)[:-1] > 0).tolist(), sorted(items))
    return out


def blocks_of_items(benchmark: DataFrame, text: str = "text", id_col: str = "item_id"):
    """The number of blocks, and an iterator of them: at most about BLOCK_BYTES (or one item) each, small enough for the driver."""
    own = benchmark.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("i IS NOT NULL AND length(t) > 0")
    size = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    return n, ([(r.i, r.t.encode()) for r in own.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).orderBy("i", "t").collect()] for k in range(n))


def search_block(docs: DataFrame, text: str, items: list, keep: list[str]) -> DataFrame:
    """One pass over docs with one block of items: the columns in keep, n_words, hit_words and items."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex  # BLOCK_BYTES at most

    def make():
        searchers, owners = compiled(name, shared)
        return lambda texts: dict(zip(("n_words", "hit_words", "items"), zip(*search_batch(searchers, owners, texts), strict=True)))

    return append_columns(docs, text, make, [field("n_words", "bigint"), field("hit_words", "array<bigint>"), field("items", "array<string>")], keep)


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, hit_words (numbers of the words inside an occurrence) and items (ids found, as sorted strings).

    A benchmark of one block is one pass. For a larger one the rows are written once with a number, each block is a job of its own
    that writes the hits it finds, and these are merged by number: neither plans nor texts pile up with the blocks.
    """
    keep = list(docs.columns if keep is None else keep)
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__t"))
    n, blocks = blocks_of_items(benchmark)
    if n == 1:
        return search_block(own, "__t", next(blocks), keep).withColumn("items", F.array_sort("items"))
    own = staged(own.withColumn("__row", F.monotonically_increasing_id()), "searched")
    found = None
    for items in blocks:
        part = staged(search_block(own, "__t", items, ["__row"]).where(F.size("items") > 0).select("__row", "hit_words", "items"), "hits")
        found = part if found is None else found.unionAll(part)
    merged = found.groupBy("__row").agg(F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    words = search_block(own, "__t", [], [*keep, "__row"]).drop("hit_words", "items")
    out = words.join(merged, "__row", "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "n_words", F.coalesce("hit_words", F.array().cast("array<bigint>")).alias("hit_words"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> F.Column:
    hit = F.size("hit_words")
    return (hit > 0) & (20 * hit >= F.col("n_words"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document: words, words hit, items found and their digest, and whether it is contaminated."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    own = docs.withColumns({f"__{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    found = find_hits(own, read(spark, sf_dir, "benchmark"), keep=[f"__{i}" for i in range(len(docs.columns))])
    return found.where(~contaminated()).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS window_text FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT row, p, n, array_to_string(w[p : p + n - 1], ' ') AS window_text FROM (SELECT d.row, d.w, l.n, unnest(range(1, len(w) - l.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) l WHERE len(w) >= l.n)),
h AS (SELECT row, p, dw.n, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.window_text = dw.window_text),
x AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS k FROM h) GROUP BY 1),
y AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN x USING (row) LEFT JOIN y USING (row)
"""
