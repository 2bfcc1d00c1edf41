"""Shared plumbing of the training-data operators: reading, staging, Arrow batches, the labelled split."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker turns into arrays at a time; longer texts are taken alone.
CHUNK_BYTES = 4 << 20
#: Most bits of a map of ids, and tasks over which a key's rows are dealt in salted joins.
MOST_BITS, SALTS = 1 << 27, 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where the session sets none, a folder of the warehouse, which is shared too.

    A warehouse on a machine's own disk is shared in local mode only: on a cluster that sets neither, this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("/", "file:")) and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{warehouse}/_shared"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Members:
    """Which 64-bit hashes may be among those of a table: one bit each in a bitmap of about 16 bits a hash, MOST_BITS at most.

    There are false hits, which cost work, but no misses. A table that would fill MOST_BITS is not mapped: all hashes hit.
    """

    def __init__(self, hashes: DataFrame):
        """hashes: one column of bigint."""
        spark, (name,) = hashes.sparkSession, hashes.columns
        n = hashes.count()
        self.bits = min(MOST_BITS, 1 << max(16, (16 * n).bit_length()))
        self.full = n > self.bits
        words = np.zeros(self.bits // 64, np.int64)
        if n and not self.full:
            at = F.pmod(F.col(name), F.lit(self.bits))
            one = F.expr(f"shiftleft(1L, cast(pmod(`{name}`, {self.bits}) % 64 as int))")
            got = hashes.groupBy((at / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # MOST_BITS / 64 rows at most
            words[got.column("word").to_numpy()] = got.column("bits").to_numpy()
        self.shared = spark.sparkContext.broadcast(words.view(np.uint8))  # MOST_BITS / 8 bytes at most

    def test(self, hashes: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(hashes), bool)
        at = hashes & (self.bits - 1)
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def column(self, hashes: Column) -> Column:
        """The test as a column of booleans."""
        test = self.test

        @F.pandas_udf("boolean")
        def listed(h: pd.Series) -> pd.Series:
            return pd.Series(test(h.to_numpy()))

        return F.lit(True) if self.full else listed(hashes)

    def __getstate__(self) -> dict:
        return self.__dict__


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """left joined with right (one row a key) where a key may hold a large share of left: each key's rows go to SALTS tasks by `spread`."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", salt).join(many, [*keys, "__salt"], how).drop("__salt")


def held_out(doc_id) -> F.Column:
    """Rows never learned from: crc32 of doc_id as text, mod 4, is 2. A null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def slices(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows whose sizes sum to at most `most`; a longer row is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batch in slices of bounded text, with each slice's texts as bytes (None for null)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes, most):
        part = batch.slice(a, b - a)
        yield part, part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; when it ends, what the worker has freed goes back to the machine: workers wait for their next task with little."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def append_columns(df: DataFrame, text: str, make: Callable[[], Callable[[list], dict]], fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) and new ones computed from texts, a slice at a time.

    make() runs once a task and returns a function from a list of texts (bytes or None) to the new columns. A column of
    df that has the name of a new one is replaced.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    inner = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*inner.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply, types = make(), None
        for batch in batches:
            for part, texts in text_chunks(batch, "__text"):
                out = apply(texts)
                if types is None:
                    types = {f.name: _arrow_type(f.dataType) for f in fields}
                arrays = [part.column(i) for i in range(len(kept))] + [pa.array(out[f.name], type=types[f.name]) for f in fields]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in fields)])

    return inner.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind])
    return simple[type(kind)]


def field(name: str, kind: str) -> T.StructField:
    return T.StructType.fromDDL(f"`{name}` {kind}").fields[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """At most `rows` labelled documents (columns __y, __text) to learn from, the same at every run: first by a hash of the id.

    Rows of the held-out quarter, without a label of 0 or 1, or whose id has two different labels are left out. Of several
    rows of one id, the text of the smallest hash is taken.
    """
    known = (
        labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label).cast("int").alias("__y"), F.max(label).cast("int").alias("__z"))
        .where("__y = __z").where(~held_out(F.col("__id"))).select("__id", "__y")
    )
    picked = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    own = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    found = own.join(F.broadcast(picked), "__id")  # `rows` rows at most are broadcast
    return found.groupBy("__id", "__y").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text")).select("__y", "__text")
