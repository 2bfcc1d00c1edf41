"""Op 8: WARC archives, written and read through Spark, with a salvaging reader.

Writing: each page becomes one record in a gzip member of its own. Equal payloads of at least MIN_PAYLOAD bytes are stored
once: the page with the largest id is the response, the others become revisits that name it. To find them only digests,
lengths and ids are shuffled; a bitmap of the revisits then tells which pages have to be joined with their response, and all
others are written where they are read. Spark's text writer puts bundles of members of BUNDLE_BYTES into files of at most
FILE_BUNDLES bundles (its line separator is an empty gzip member, so the files are ordinary .warc.gz), which makes the
output as safe against lost tasks as any Spark output, on any file system that Spark knows.

Reading: files come in through Spark's binaryFile source. A record is taken if its member inflates, its version line and
headers parse, and its lengths and digests agree. After a failed check the reader looks for the next place from which a valid
record can be read: inside a member the next version line of what it inflated to (also if it is cut off or ends in damage),
outside the next gzip magic or version line. The bytes in between are reported as a gap: with gap_bytes of the file, or, inside a
member, of what it inflated to (inside is true). log_gaps() writes these rows to a table.

Defined results: a null html is an empty payload; payloads under MIN_PAYLOAD are always responses; pages that share both
the payload and the largest id are all responses, and their copies refer to that id; a null page_id is written as "null"
and read back as null, and such a page is a response only if no page with the same payload has an id.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Members, read, salted_join, shared_path, staged

MIN_PAYLOAD = 1000
#: Bytes of members that one line of the writer holds (a longer member is a line of its own), and lines of a file.
BUNDLE_BYTES, FILE_BUNDLES = 4 << 20, 48
#: An empty gzip member, which readers skip.
SEPARATOR = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
RECORD = "page_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string, payload binary, file string, offset bigint, inside boolean, gap_bytes bigint, reason string"


def build_record(page_id, url, payload: bytes, digest: str, refers_to, full_length: int | None = None) -> bytes:
    """A record; full_length is the payload's length where the payload itself is not stored (revisits)."""
    revisit = refers_to is not None
    full_length = len(payload) if full_length is None else full_length
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}", f"X-Payload-Length: {full_length}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: memoryview) -> tuple[dict, int]:
    """The record at the start of data and its length; raises ValueError with what is wrong."""
    head, end = b"", -1
    while end < 0 and len(head) < len(data):  # headers have no fixed limit: look further in growing steps
        head = bytes(data[: 4096 if not head else 4 * len(head)])
        if not head.startswith(VERSION):
            break
        end = head.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no version line or no end of the headers")
    try:
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in head[:end].decode().split("\r\n")[1:])}
        n, full = int(fields["content-length"]), int(fields["x-payload-length"])
        page = re.fullmatch(r"<urn:page:(-?\d+|null)>", fields["warc-record-id"])[1]
        refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields["warc-refers-to"])[1] if "warc-refers-to" in fields else None
        digest, block, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-block-digest"].removeprefix("sha1:"), fields["warc-type"]
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"bad headers: {e}") from None
    body, stop = bytes(data[end + 4 : end + 4 + max(n, 0)]), end + 8 + n
    if n < 0 or len(body) < n or bytes(data[end + 4 + n : stop]) != b"\r\n\r\n":
        raise ValueError("wrong length")
    if hashlib.sha1(body).hexdigest() != block or kind == "response" and (digest != block or full != n):
        raise ValueError("wrong digest")
    return {"page_id": None if page == "null" else int(page), "record_type": kind, "refers_to": refers and int(refers), "url": fields.get("warc-target-uri"), "payload_bytes": full, "payload_digest": digest, "payload": body if kind == "response" else None}, stop


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at an offset inflates to, where its data end, and what is wrong with it ("" if nothing)."""
    z, out, step, k = zlib.decompressobj(31), [], 1 << 16, at
    while not z.eof and k < len(data):
        try:
            out.append(z.decompress(data[k : k + step]))
        except zlib.error as e:
            if step > 1:  # what comes before the damaged byte can still be inflated
                z, out, step = _before(data, at, k)
            return b"".join(out), k, f"bad member: {e}"
        k += step
    return b"".join(out), min(k, len(data)) - len(z.unused_data), "" if z.eof else "member is cut off"


def _before(data: bytes, at: int, stop: int):
    """The member's output up to `stop`, and byte by byte from there to the damage."""
    z = zlib.decompressobj(31)
    out = [z.decompress(data[at:stop])]
    try:
        for k in range(stop, min(stop + (1 << 16), len(data))):
            out.append(z.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return z, out, 1


def plain_records(data: bytes) -> Iterator[dict]:
    """Records (with their place, at and end) of bytes without members; after a failed check, gaps (at, end, reason) to the next readable version line."""
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            r, n = parse_record(memoryview(data)[at:])
        except ValueError as e:
            gap, why = (at, str(e)) if gap is None else (gap, why)
            at = data.find(VERSION, at + 1)
            at = len(data) if at < 0 else at
            continue
        if gap is not None:
            yield {"at": gap, "end": at, "reason": why}
            gap = None
        yield {**r, "at": at, "end": at + n}
        at += n
    if gap is not None:
        yield {"at": gap, "end": len(data), "reason": why}


def salvage(data: bytes) -> Iterator[dict]:
    """All records that can be read, as dicts with their offset, and a dict with gap_bytes and reason for each gap."""
    at, gap, why = 0, None, ""
    while at < len(data):
        found, lost, end, bad = [], [], at, ""
        if data.startswith(MAGIC, at):
            plain, end, bad = inflate(data, at)
            for r in plain_records(plain):
                (lost if "reason" in r else found).append(r)
            if bad and lost and lost[-1]["end"] == len(plain):
                lost.pop()  # the cut record is part of the damaged member's gap
            if not bad and plain and not found:
                bad, lost = lost[0]["reason"], []
        else:
            try:
                r, n = parse_record(memoryview(data)[at:])
                found, end = [r], at + n
            except ValueError as e:
                bad = str(e)
        if (found or not bad) and gap is not None:
            yield {"offset": gap, "inside": False, "gap_bytes": at - gap, "reason": why}
            gap = None
        for r in found:
            yield {k: v for k, v in r.items() if k not in ("at", "end")} | {"offset": at}
        for r in lost if found else []:
            yield {"offset": at, "inside": True, "gap_bytes": r["end"] - r["at"], "reason": r["reason"]}
        if bad:
            gap, why = (at, bad) if gap is None else (gap, why)
            m = START.search(data, at + 1)
            at = m.start() if m else len(data)
        else:
            at = end
    if gap is not None:
        yield {"offset": gap, "inside": False, "gap_bytes": len(data) - gap, "reason": why}


def digested(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (20 bytes), n."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    return own.select("*", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("bigint").alias("n"))


def revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, digest, n, response: every page that another page's record stands for. Payloads are not shuffled."""
    keys = digested(pages).where(F.col("n") >= min_payload).select("page_id", "digest", "n")
    twice = keys.groupBy("digest", "n").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1 AND response IS NOT NULL").drop("copies")
    return salted_join(keys, twice, ["digest", "n"], F.col("page_id")).where("NOT page_id <=> response").select("page_id", "digest", "n", "response").distinct()


def resolve(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """pages as page_id, url, payload (null for revisits), digest, n, refers_to (null for responses)."""
    found = staged(revisits(pages, min_payload), "warc-revisits")
    known = Members(found.select(F.xxhash64("page_id", "digest").alias("h")))
    own = digested(pages).withColumn("maybe", (F.col("n") >= min_payload) & known.column(F.xxhash64("page_id", "digest")))
    to_join = found.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("n").alias("m"), "response")
    joined = own.where("maybe").join(to_join.hint("merge"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")), "left")
    joined = joined.select("page_id", "url", F.when(F.col("response").isNull(), F.col("payload")).alias("payload"), "digest", "n", F.col("response").alias("refers_to"))
    plain = own.where("NOT maybe").select("page_id", "url", "payload", "digest", "n", F.lit(None).cast("bigint").alias("refers_to"))
    return plain.unionAll(joined).withColumn("digest", F.lower(F.hex("digest")))


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """One gzip member a page; a task's members fill files of about BUNDLE_BYTES * FILE_BUNDLES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, digest, n, refers in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                held.append(member(build_record(page_id, url, payload if payload is not None else b"", digest, refers, n)))
                size += len(held[-1])
                if size >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)], pa.binary())], names=["members"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)], pa.binary())], names=["members"])

    members = resolve(pages, min_payload).mapInArrow(run, "members binary")
    members.select(F.col("members").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_BUNDLES).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all files under path: the columns of RECORD; a gap has only file, offset, inside, gap_bytes and reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("inside", pa.bool_()), ("gap_bytes", pa.int64()), ("reason", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):
                file, content, rows, size = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), [], 0
                for r in salvage(content):
                    rows.append(r | {"file": file})
                    size += len(r.get("payload") or b"") + 300
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInArrow(run, RECORD)


def log_gaps(records: DataFrame, path: str) -> DataFrame:
    """Writes the gaps among what read_archives() gave to a table under path, and returns it."""
    gaps = records.where("reason IS NOT NULL").select("file", "offset", "inside", "gap_bytes", "reason")
    gaps.write.parquet(path)
    return records.sparkSession.read.schema(gaps.schema).parquet(path)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Every page, read back from the archives it was written to; gaps, if any, are logged beside them."""
    path = shared_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    records = staged(read_archives(spark, path).drop("payload"), "warc-records")
    log_gaps(records, f"{path}-gaps")
    return records.where("reason IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM (SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS response
      FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages))
"""
