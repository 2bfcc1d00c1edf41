import hashlib
import random

from pyspark.sql import functions as F

from barline.llm import warc


def test_round_trip(spark, tmp_path):
    big, other = "é" * 600, "x" * 1200
    rows = [(1, "u1", big), (2, "u2", big), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "small"), (6, "u6", "small"), (7, "u7", other), (8, "u8", big), (9, "u9", "a\r\n\r\nWARC/1.1\r\nx"), (None, "n", other), (None, "n", "lone" * 400), (8, "u8", big)]
    spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, warc.op8_warc(spark, str(tmp_path)).collect()), key=str)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        same = [q for q, _, g in rows if (g or "") == (h or "") and q is not None] if len(b) >= 1000 else [p]
        first = max(same, default=None)
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if p == first else "revisit", None if p == first else first))
    assert got == sorted(want, key=str)
    path = f"{tmp_path}/w"
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), path)
    payloads = warc.read_archives(spark, path).where("record_type = 'response'").select("page_id", F.decode("payload", "utf-8")).collect()
    assert {(r[0], r[1]) for r in payloads} >= {(7, other), (8, big), (3, ""), (9, "a\r\n\r\nWARC/1.1\r\nx")}


def test_salvage_recovers_later_records():
    recs = [warc.build_record(i, "u", (f"page {i} " * 50).encode(), hashlib.sha1((f"page {i} " * 50).encode()).hexdigest(), None) for i in range(6)]
    members = [warc.member(r) for r in recs]
    rnd = random.Random(1)
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + warc.SEPARATOR + members[1] + bytes(broken) + members[3] + bytes(rnd.randrange(256) for _ in range(100)) + recs[4] + members[5][: len(members[5]) // 2]
    out = list(warc.salvage(data))
    assert [r["page_id"] for r in out if "page_id" in r] == [0, 1, 3, 4]
    gaps = [r for r in out if "reason" in r]
    assert [g["gap_bytes"] for g in gaps] == [len(broken), 100, len(members[5]) // 2]
    assert gaps[0]["offset"] == data.index(bytes(broken))


def test_wrong_length_and_digest_are_quarantined():
    good = warc.build_record(1, None, b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    for bad in (good.replace(b"Content-Length: 3", b"Content-Length: 9"), good.replace(b"abc", b"abd"), good.replace(b"urn:page:1", b"urn:page:x")):
        out = list(warc.salvage(bad + good))
        assert [r["page_id"] for r in out if "page_id" in r] == [1]
        assert sum(r.get("gap_bytes", 0) for r in out) == len(bad)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op8_warc(spark, str(tmp_path)).count() == 0


def page(i, n=50):
    body = f"page {i} ".encode() * n
    return warc.build_record(i, "u", body, hashlib.sha1(body).hexdigest(), None)


def ids(data):
    return [r["page_id"] for r in warc.salvage(data) if "page_id" in r]


def test_headers_quoted_in_a_url_change_nothing(spark, tmp_path):
    """A url may look like a header; a revisit still has the length of its own payload."""
    rows = [(k, "http://h/?X-Payload-Length: 0\r\nContent-Length: 7", "y" * 1500) for k in (1, 2)] + [(3, "u" * 100_000, "z")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.op8_warc(spark, str(tmp_path)).collect()}
    assert got == {1: (1500, "revisit", 2), 2: (1500, "response", None), 3: (1, "response", None)}
    path = f"{tmp_path}/w"
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), path)
    assert {len(r.url) for r in warc.read_archives(spark, path).collect()} == {47, 100_000}


def test_records_behind_damage_inside_a_member_are_recovered():
    recs = [page(i) for i in range(4)]
    for bad in range(4):
        broken = [r.replace(b"page", b"pxge", 2) if k == bad else r for k, r in enumerate(recs)]
        out = list(warc.salvage(warc.member(b"".join(broken)) + warc.member(page(9))))
        assert [r["page_id"] for r in out if "page_id" in r] == [k for k in range(4) if k != bad] + [9]
        assert [(r["inside"], r["gap_bytes"]) for r in out if "reason" in r] == [(True, len(recs[bad]))]


def test_cut_or_damaged_member_keeps_its_complete_records():
    rnd = random.Random(3)
    noise = [bytes(rnd.randrange(256) for _ in range(3000)) for _ in range(4)]
    recs = [warc.build_record(k, None, b, hashlib.sha1(b).hexdigest(), None) for k, b in enumerate(noise)]
    whole = warc.member(b"".join(recs))
    assert ids(whole[: len(whole) * 3 // 4]) == [0, 1, 2] or ids(whole[: len(whole) * 3 // 4]) == [0, 1]
    assert ids(whole[: len(whole) * 3 // 4] + warc.member(page(7)))[-1] == 7
    out = list(warc.salvage(whole[:-4]))
    assert [r["page_id"] for r in out if "page_id" in r] == [0, 1, 2, 3] and [r["reason"] for r in out if "reason" in r] == ["member is cut off"]


def test_long_payloads_fill_several_bundles_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2000)
    monkeypatch.setattr(warc, "FILE_BUNDLES", 3)
    rnd = random.Random(2)
    rows = [(k, None, "".join(rnd.choice("abcdefgh") for _ in range(3_000_000 if k == 5 else 4000))) for k in range(20)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    path = f"{tmp_path}/w"
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), path)
    got = warc.read_archives(spark, path)
    assert {r.page_id: len(r.payload) for r in got.collect()} == {k: len(t) for k, _, t in rows}
    assert got.select("file").distinct().count() == 7


def test_gaps_are_logged(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.member(page(1)) + b"junk" + warc.member(page(2)))
    records = warc.read_archives(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in warc.log_gaps(records, f"{tmp_path}-gaps").collect()] == [(len(warc.member(page(1))), False, 4, "no version line or no end of the headers")]
