"""Op 10: token ids in binary files with a shared zstandard dictionary.

Encoding: the tokenizer's own library turns texts into ids. A byte-level BPE with the usual pre-tokenizer never joins
anything across a single blank or line end between visible characters, so each worker encodes every distinct such piece
once and looks the rest up; texts with other runs of white space, or that quote an added token such as <|endoftext|> (which
the library turns into its one id), are encoded whole.

Files: documents are dealt to shards of ascending doc_id (ties by their ids' bytes), each shard sorted, and written as
blocks. A block holds a header with the dictionary's hash, an index (doc_id, number of ids, offset, length) and one
zstandard frame a document, so that a short document can be read without its neighbours. Spark's text writer puts blocks
into files of at most FILE_BLOCKS blocks (each followed by a line end), and Spark's binaryFile source reads them. The number of shards
follows from the bytes of text; a shard of many bytes is several files.

Defined results: a null text is empty and has just the end id; a null doc_id sorts first; repeated rows are each written;
a frame that does not match its block's dictionary hash, length or check sum raises an error.
"""

from __future__ import annotations

import hashlib
import os
import string
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import append_columns, field, read, shared_path, staged

END_ID = 2
SAMPLE_ROWS, SAMPLE_IDS, DICT_BYTES = 1000, 16_384, 64 << 10
BLOCK_BYTES, FILE_BLOCKS = 4 << 20, 12
#: Bytes of text for each shard and for each task that writes them, and most shards (beyond them, shards grow and have more files).
SHARD_BYTES, TASK_BYTES, MOST_SHARDS = 1 << 20, 16 << 20, 20_000
#: Consecutive shards whose files share a folder, so that a document is looked for in the files of one folder only.
FOLDER_SHARDS = 4
MAGIC = b"TIDS"
HEAD = "<4sB32sIIIQII"  # magic, id width, dictionary hash, shard, block, documents, ids before in the shard, frame bytes, crc32 of index and frames
INDEX = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n", "<u4"), ("crc", "<u4"), ("offset", "<u4"), ("length", "<u4")])
CACHE_PIECES, SEEN_MASK = 150_000, (1 << 22) - 1
MARKS = string.punctuation

#: The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the others from U+0100 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
BYTE_TABLE = "".join(chr(_HIDDEN.get(b, b)) for b in range(256))


class Encoder(dict):
    """Texts to little-endian unsigned 32-bit ids, by the tokenizers library. As a dict it holds the ids of pieces seen; None for odd ones."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        state = self.tokenizer.pre_tokenizer.__getstate__() if self.tokenizer.pre_tokenizer else b""
        self.pieces = b'"ByteLevel"' in state and b'"add_prefix_space":false' in state and b'"use_regex":true' in state and not self.tokenizer.normalizer
        self.tokenize, self.small = self.tokenizer.model.tokenize, {c: self.whole([c])[0] for c in ("", "\n")}
        self.before: dict[str, bytes | None] = {}  # pieces of the last filling
        self.seen = bytearray(SEEN_MASK + 1)
        self.wide = self.tokenizer.get_vocab_size() > 65_535

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __missing__(self, piece: str) -> bytes | None:
        """Ids of a piece that follows a blank, or begins with a line end; None where white space stands at its ends."""
        slot, seen = hash(piece) & SEEN_MASK, self.seen
        again, seen[slot] = seen[slot], 1
        if self.before and piece in self.before:
            self[piece] = value = self.before[piece]
            return value
        if piece.isalpha() and (piece.isascii() or max(piece) < "\u0250"):  # a word of letters is one pre-token: most misses are such words
            value = array("I", [t.id for t in self.tokenize("\u0120" + charmap_decode(piece.encode(), "strict", BYTE_TABLE)[0])]).tobytes()
        else:
            value = self.other(piece)
        if again:  # most pieces come once: only those that come again are kept
            if len(self) > CACHE_PIECES:
                self.before = dict(self)
                self.clear()
                self.seen = bytearray(SEEN_MASK + 1)
            self[piece] = value
        return value

    def other(self, piece: str) -> bytes | None:
        """As __missing__, for other pieces. The pre-tokens of a word of letters (below U+0250) and a tail of ASCII marks are known, so the model itself is asked."""
        line = piece[:1] == "\n"
        body = piece.rstrip(MARKS)
        tail, body = piece[len(body) :], body[line:]
        if body.isalpha() and (body.isascii() or max(body) < "\u0250"):
            if tail and tail not in self.small:
                self.small[tail] = self.whole([tail])[0]
            if tail and not line:
                return self[body] + self.small[tail]
            body = charmap_decode(body.encode(), "strict", BYTE_TABLE)[0]
            value = array("I", [t.id for t in self.tokenize(body if line else "\u0120" + body)]).tobytes()
            return self.small["\n"] + value + self.small[tail] if line else value
        if not (rest := piece[line:]) or rest[0].isspace() or rest[-1].isspace():
            return None
        return self.whole([piece if line else " " + piece])[0]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.pieces:
            return self.whole(texts)
        out, slow, get = [], [], self.__getitem__
        for k, text in enumerate(texts):
            first, *rest = text.replace("\n", " \n").split(" ")
            try:
                if rest and (not first or first[-1].isspace()) or any(map(text.__contains__, self.added)):
                    raise TypeError
                out.append((self.whole([first])[0] if first else b"") + b"".join(map(get, rest)))
            except TypeError:  # an added token, or white space other than single blanks and line ends
                slow.append(k)
                out.append(b"")
        for k, ids in zip(slow, self.whole([texts[k] for k in slow]), strict=True):
            out[k] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One to a worker process; what it has learned serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def serialized(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> tuple[bytes, int]:
    """A dictionary from at most SAMPLE_ROWS documents (first by a hash of the id), SAMPLE_IDS ids of each; and the bytes of all texts, observed in the same pass."""
    picked = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    seen = Observation("texts")
    sample = docs.observe(seen, F.sum(F.octet_length("text")).alias("size")).join(F.broadcast(picked), "doc_id")  # SAMPLE_ROWS ids

    def make():
        e = encoder(path)
        return lambda texts: {"ids": [serialized(x[: 4 * SAMPLE_IDS], e.wide) for x in e([(t or b"").decode() for t in texts])]}

    got = append_columns(sample, "text", make, [field("ids", "binary")], keep=[]).collect()
    samples = [bytes(r.ids) for r in got if r.ids]
    # without sampled rows the texts may not have been read at all
    size = (seen.get if got else docs.agg(F.sum(F.octet_length("text")).alias("size")).first().asDict())["size"] or 0
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes(), size
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their own bytes serve as the dictionary
        return b"".join(samples)[-DICT_BYTES:] or b"\0" * 8, size


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """docs (doc_id, text) as token files under path/blocks, with the dictionary under path/dictionary."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary, size = train_dictionary(docs, tokenizer_path, end_id)
    spark.createDataFrame([(dictionary,)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shards = shards or max(1, min(MOST_SHARDS, -(-size // SHARD_BYTES)))
    cuts = sorted({int(x) for x in docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / shards for k in range(1, shards)], max(1e-4, 0.2 / shards))}) if shards > 1 else []
    shared, digest = spark.sparkContext.broadcast((dictionary, np.array(cuts, np.int64))), hashlib.sha256(dictionary).digest()
    # shard k holds the ids from above cuts[k - 1] to cuts[k]
    last = len(cuts) // FOLDER_SHARDS
    ranges = [(f, cuts[f * FOLDER_SHARDS - 1] + 1 if f else None, cuts[(f + 1) * FOLDER_SHARDS - 1] if f < last else None) for f in range(last + 1)]
    spark.createDataFrame(ranges, "folder int, low bigint, high bigint").coalesce(1).write.parquet(f"{path}/folders")  # a row for FOLDER_SHARDS shards

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import text_chunks

        e, (words, at) = encoder(tokenizer_path), shared.value
        z = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=False)
        end = struct.pack("<I", end_id)
        for batch in batches:
            for part, texts in text_chunks(batch, "text"):
                ids = [x + end for x in e([(t or b"").decode() for t in texts])]
                doc = part.column(0)
                shard = np.searchsorted(at, doc.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), doc, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([z.compress(serialized(x, e.wide)) for x in ids], pa.binary())], names=["shard", "doc_id", "n", "crc", "frame"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 4 if encoder(tokenizer_path).wide else 2
        shard, number, before, rows, frames, size = None, 0, 0, [], [], 0

        def block():
            body = np.array(rows, INDEX).tobytes() + b"".join(frames)
            return struct.pack(HEAD, MAGIC, width, digest, shard, number, len(rows), before, size, zlib.crc32(body)) + body

        def made(shard: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard // FOLDER_SHARDS], pa.int32()), pa.array([block()], pa.binary())], names=["folder", "block"])

        for batch in batches:
            for s, d, n, crc, frame in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if rows and (s != shard or size + len(frame) > BLOCK_BYTES):
                    yield made(shard)
                    before, number = before + sum(r[2] for r in rows), number + 1
                    rows, frames, size = [], [], 0
                if s != shard:
                    shard, number, before = s, 0, 0
                rows.append((d is not None, d or 0, n, crc, size, len(frame)))
                frames.append(frame)
                size += len(frame)
        if rows:
            yield made(shard)

    encoded = docs.mapInArrow(encode, "shard int, doc_id bigint, n bigint, crc bigint, frame binary")
    folder = F.floor(F.col("shard") / FOLDER_SHARDS)
    dealt = encoded.repartition(max(1, -(-size // TASK_BYTES)), folder).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n", "crc", "frame")
    value = F.col("block").cast("string").alias("value")
    dealt.mapInArrow(blocks, "folder int, block binary").select("folder", value).write.partitionBy("folder").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/blocks")


def parse_blocks(data: bytes) -> Iterator[tuple[dict, np.ndarray, int]]:
    """Header, index and place of the frames of each block of a file."""
    at = 0
    while at < len(data):
        magic, width, digest, shard, number, n, before, size, crc = struct.unpack_from(HEAD, data, at)
        body = at + struct.calcsize(HEAD)
        frames = body + n * INDEX.itemsize
        if magic != MAGIC or zlib.crc32(data[body : frames + size]) != crc:
            raise ValueError(f"damaged block at {at}")
        yield {"width": width, "digest": digest, "shard": shard, "before": before}, np.frombuffer(data, INDEX, n, body), frames
        at = frames + size + 1  # and the writer's line end


def block_files(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The contents of the block files; with a list of ids, of those that can hold one of them."""
    files = spark.read.format("binaryFile").load(f"{path}/blocks")
    if only is not None and "folder" in files.columns:  # without documents there is no folder
        wanted = spark.createDataFrame([(int(i),) for i in only], "id bigint")
        holds = F.col("id").between(F.coalesce("low", F.lit(-(2**63))), F.coalesce("high", F.lit(2**63 - 1)))
        folders = spark.read.parquet(f"{path}/folders").join(F.broadcast(wanted), holds).select("folder").distinct()  # a short list of ids
        files = files.where(F.col("folder").isin([r.folder for r in folders.collect()]))  # a partition filter: other folders are not opened
    return files.where("length > 0").select("content")


def read_tokens(spark: SparkSession, path: str, only: list[int] | None = None, ids: bool = False) -> DataFrame:
    """The documents of the files (or those of a short list of ids): shard, before (ids before it in the shard), doc_id, n_tokens, ids_crc32; with ids also the ids."""
    dictionary = spark.read.parquet(f"{path}/dictionary").first().dictionary
    shared, wanted = spark.sparkContext.broadcast(bytes(dictionary)), None if only is None else np.array(sorted(only), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value))
        digest = hashlib.sha256(shared.value).digest()
        for batch in batches:
            for data in (batch.column(0)[i].as_py() for i in range(batch.num_rows)):
                for head, index, frames in parse_blocks(data):
                    if head["digest"] != digest:
                        raise ValueError("the block was written with another dictionary")
                    starts = head["before"] + np.concatenate([[0], np.cumsum(index["n"], dtype=np.int64)[:-1]])
                    rows = range(len(index)) if wanted is None else np.flatnonzero(np.isin(index["doc_id"], wanted) & (index["known"] == 1)).tolist()
                    got, crcs = [], []
                    for k in rows:
                        a = frames + int(index["offset"][k])
                        own = np.frombuffer(z.decompress(data[a : a + int(index["length"][k])]), f"<u{head['width']}").astype("<u4")
                        crcs.append(zlib.crc32(own.tobytes()))
                        if len(own) != index["n"][k] or crcs[-1] != index["crc"][k]:
                            raise ValueError("the ids of a document do not match its index")
                        if ids:
                            got.append(own)
                    rows = np.array(rows, np.int64)
                    cols = [pa.array(np.full(len(rows), head["shard"], np.int64)), pa.array(starts[rows]), pa.array(index["doc_id"][rows].astype(np.int64), mask=index["known"][rows] == 0), pa.array(index["n"][rows].astype(np.int64)), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(got, pa.list_(pa.int64()))] * ids, names=["shard", "before", "doc_id", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return block_files(spark, path, only).mapInArrow(run, "shard bigint, before bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)


def with_starts(tokens: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before. The running sum is over one total a shard."""
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    ahead = totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return tokens.join(F.broadcast(ahead), "shard").withColumn("start", F.col("ahead") + F.col("before"))  # a row a shard


def op10_token_store(spark, sf_dir: str) -> DataFrame:
    """Every document, from the files: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return with_starts(staged(read_tokens(spark, path), "token-index")).select("doc_id", "start", "n_tokens", "ids_crc32")
