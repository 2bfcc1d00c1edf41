"""Op 12: words that differ by one inserted, deleted or replaced code point, and the form that each word belongs to.

Words: maximal runs of letters, A-Z in lower case; of an occurrence whose hash with the document's id 97 divides, one code point is
deleted. Counting is one aggregation with partial sums.

Candidates: two words of which the longer has m code points are near if and only if common prefix + common suffix >= m - 1. The
length p of the common prefix falls in one of BANDS bands [low, high) of 0 .. m - 1; then both words share their first low and
their last m - high code points. So each word is listed under these keys for m = its length and m = its length + 1, and a pair
is compared under one key only: that of the longer word's length and of its p. A key held by more than BLOCK words
is replaced by bands of one p each, which share m - 1 code points: such a key holds no more words than there are letters, plus one.

Tiles: the words of a key are padded matrices of code points, once left and once right aligned; blocks of them are compared
with each other at once, and prefix and suffix lengths are read off where rows first differ. Small groups of one size are compared
together. Blocks of long words have fewer rows.

Forms: near words are counted and the most frequent one found by partial aggregates; roots by pointer doubling (a form's count is at
least twice its word's, so chains end, after log2 of the largest count at most).

Defined results: null and empty texts have no words; a null doc_id counts as an empty one in the hash; repeated rows count each; words
of any length are compared whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, staged

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MODULUS, LEAST_LETTERS, LEAST_COUNT, FORM_TIMES = 97, 5, 3, 2
#: Bands of the common prefix's length, words of a key that are compared as they are, and cells of a tile of comparisons.
BANDS, BLOCK, TILE_CELLS = 4, 512, 1 << 22
MOST_ROUNDS = 64


def words(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): the distinct words of at least LEAST_LETTERS code points and LEAST_COUNT occurrences."""
    runs = F.regexp_extract_all(F.translate(F.col(text).cast("string"), UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).where(F.length("run") >= LEAST_LETTERS)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % MODULUS == 0, less).otherwise(F.col("run")).alias("word")
    return run.select(word).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def bands(m: Column, n: Column) -> Column:
    """The n bands of 0 .. m - 1 as structs (low, high), of widths as even as may be."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.floor(m * k / n).cast("int").alias("low"), F.floor(m * (k + 1) / n).cast("int").alias("high")))


def band_key(word: Column, m: Column, band: Column) -> Column:
    """What words under one key share: m, the band and the code points before and behind it."""
    behind = m - band["high"]
    tail = F.when(behind > 0, F.substring(word, F.length(word) - behind + 1, behind)).otherwise("")
    return F.xxhash64(m, band["low"], band["high"], F.substring(word, F.lit(1), band["low"]), tail)


def listed(vocabulary: DataFrame, fine: bool) -> DataFrame:
    """(key, word, n, m, low, high) of each word and band, or of each band of width one."""
    w = F.col("word")
    two = vocabulary.withColumn("m", F.explode(F.array(F.length(w), F.length(w) + 1)))
    each = two.withColumn("band", F.explode(bands(F.col("m"), F.col("m") if fine else F.lit(BANDS))))
    return each.select(band_key(w, F.col("m"), F.col("band")).alias("key"), "word", "n", "m", F.col("band.low").alias("low"), F.col("band.high").alias("high"))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (word, n) -> (word, near, near_n): each near pair once in both directions."""
    coarse = listed(vocabulary, fine=False)
    full = F.sum((F.length("word") == F.col("m")).cast("int"))
    sizes = staged(coarse.groupBy("key").agg(F.count("*").alias("size"), full.alias("full")).where("size > 1 AND full > 0").select("key", "size"), "spelling-keys")
    small = coarse.join(sizes.where(F.col("size") <= BLOCK), "key").drop("size")
    large = coarse.join(sizes.where(F.col("size") > BLOCK), "key").select("word", "n", "m", F.col("low").alias("from"), F.col("high").alias("to"))
    band = F.struct(F.col("p").alias("low"), (F.col("p") + 1).alias("high"))
    large = large.withColumn("p", F.explode(F.sequence(F.col("from"), F.col("to") - 1))).select(band_key(F.col("word"), F.col("m"), band).alias("key"), "word", "n", "m", F.col("p").alias("low"), (F.col("p") + 1).alias("high"))
    grouped = small.unionAll(large).repartition("key").sortWithinPartitions("key", "m", "low", "high", "word")
    return grouped.mapInArrow(compare, "word string, near string, near_n bigint")


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> near pairs. A key's last rows of a batch wait for the next one; a key has few rows."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None and rest.num_rows:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = batch.column(0).to_numpy()
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        rest = batch.slice(done)
        yield from _pairs(batch.slice(0, done))
    if rest is not None:
        yield from _pairs(rest)


def _pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    key, n, m, low, high = (batch.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
    text = batch.column(1).to_pylist()
    marks = np.flatnonzero((np.diff(key, prepend=key[:1] - 1) != 0) | (np.diff(m, prepend=0) != 0) | (np.diff(low, prepend=-1) != 0) | (np.diff(high, prepend=-1) != 0)) if len(key) else np.zeros(0, int)
    sizes = np.diff(marks, append=len(key))
    left, right = [], []
    for size in np.unique(sizes[sizes > 1]).tolist():
        starts = marks[sizes == size]
        starts = starts[np.argsort(m[starts], kind="stable")]  # words of like lengths together: little padding
        at = 0
        while at < len(starts):
            width = int(m[starts[at]])
            block = max(1, min(size, int((TILE_CELLS // width) ** 0.5)))
            many = max(1, TILE_CELLS // (width * size * size)) if block == size else 1
            own = starts[at : at + many]
            own = own[m[own] <= 2 * width]
            at += len(own)
            rows = own[:, None] + np.arange(size)
            for a in range(0, size, block):
                for b in range(a, size, block):
                    i, j = _tile(text, rows[:, a : a + block], rows[:, b : b + block], m[own], low[own], high[own], a == b)
                    left.append(i)
                    right.append(j)
    if not left:
        return
    i, j = np.concatenate(left), np.concatenate(right)
    words = pa.array(text, pa.string())
    one, two = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
    yield pa.RecordBatch.from_arrays([words.take(one), words.take(two), pa.array(n).take(two)], names=["word", "near", "near_n"])


def matrices(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and the code points left aligned and reversed, padded with zeros."""
    size = np.array([len(t) for t in texts])
    fill = np.arange(width) < size[:, None]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    ahead, back = np.zeros((len(texts), width), np.uint32), np.zeros((len(texts), width), np.uint32)
    ahead[fill] = points
    ends = np.repeat(np.cumsum(size), size)
    back[fill] = points[ends - 1 - (np.arange(len(points)) - (ends - np.repeat(size, size)))]
    return size, ahead, back


def _tile(text: list[str], a: np.ndarray, b: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs between two blocks of each group (rows of a and b): their row numbers."""
    width = int(m.max())
    (la, fa, ra), (lb, fb, rb) = (tuple(x.reshape(*w.shape, *x.shape[1:]) for x in matrices([text[k] for k in w.ravel().tolist()], width)) for w in (a, b))

    def shared(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
        differ = x[:, :, None, :] != y[:, None, :, :]
        first = np.where(differ.any(axis=-1), differ.argmax(axis=-1), width)
        return np.minimum(first, np.minimum(sx[:, :, None], sy[:, None, :]))

    prefix, longest = shared(fa, fb, la, lb), np.maximum(la[:, :, None], lb[:, None, :])
    m, low, high = (x[:, None, None] for x in (m, low, high))
    ok = (longest == m) & (prefix >= low) & (prefix < high) & (prefix + shared(ra, rb, la, lb) >= m - 1)
    if same:
        ok &= np.triu(np.ones(ok.shape[1:], bool), 1)
    g, i, j = np.nonzero(ok)
    return a[g, i], b[g, j]


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> (word, root): the last form of each word that has one, by pointer doubling."""
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(MOST_ROUNDS):
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        new = staged(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now
    raise RuntimeError(f"roots not found in {MOST_ROUNDS} rounds")


def spelling(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (word, n), each word once -> word, n, n_near, form, form_n, root."""
    pairs = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    best_n = -F.col("best.n")
    found = vocabulary.join(pairs, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(best_n >= FORM_TIMES * F.col("n"), F.struct(F.col("best.near").alias("form"), best_n.alias("form_n"))).alias("f"))
    found = staged(found.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.form_n").alias("form_n")), "spelling-forms")
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Every word: word, n, n_near, form, form_n, root."""
    vocabulary = staged(words(read(spark, sf_dir, "documents")), "spelling-words")
    return spelling(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = r"""
WITH RECURSIVE steps AS (SELECT i AS slot, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT slot, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY slot) AS t FROM steps WHERE k = 8),
runs AS MATERIALIZED (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, [4294967295] || flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM own),
hashed AS MATERIALIZED (SELECT run, n, xor(4294967295, list_reduce(b, lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1]))) AS h FROM bytes, crc),
vocabulary AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN run[1 : CAST(h % length(run) AS INT)] || run[CAST(h % length(run) AS INT) + 2 :] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS MATERIALIZED (SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM vocabulary)),
near AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.rest, a.word, a.n FROM holes a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT a.word, a.rest, b.n FROM holes a JOIN vocabulary b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last, 0 AS k FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(last, k) FROM chain c WHERE c.word = f.word) AS root, n, n_near, form_n FROM forms f"""
