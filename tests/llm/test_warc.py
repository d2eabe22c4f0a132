import base64
import glob
import gzip
import hashlib
import os
import random
import re
from collections import Counter

from chronoweave.llm import warc
from chronoweave.llm.common import new_folder


def test_round_trip_and_revisits(spark):
    big = "z\r\n\r\nWARC/1.1\r\n\r\n" * 3000
    rows = [(5, "http://a.org/x", "same", 1), (3, "http://b.org", "same", 1), (9, None, None, 1), (8, "u", "", 1), (7, "http://é/\r\n", "é\n", 1),
            (7, "http://é/\r\n", "é\n", 1), (2, "http://c", big, 1), (1, "http://d", big, 1), (None, "http://n", "same", 1), (3, "http://zz", "other", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    folder = new_folder(spark, "t")
    warc.write_archives(pages, folder)
    records = warc.read_records(spark, folder, with_payload=True)
    assert records.count() == 3 * len(rows)
    got = warc.assemble(records).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.request.record_id.endswith(":request") and r.metadata.payload_bytes is not None
    payload = {}
    for r in got:
        if r.response.kind == "response":
            payload[r.response.payload_digest] = bytes(r.response.payload)
            assert base64.b32encode(hashlib.sha1(r.response.payload).digest()).decode() == r.response.payload_digest
    for r in got:
        assert len(payload[r.response.payload_digest]) == r.metadata.payload_bytes
    kinds = Counter((r.page_id, r.response.kind, r.response.refers_to) for r in got)
    assert kinds == Counter([("5", "revisit", "3"), ("3", "response", None), ("3", "response", None), ("9", "revisit", "8"), ("8", "response", None),
                             ("7", "response", None), ("7", "revisit", "7"), ("2", "revisit", "1"), ("1", "response", None), ("None", "revisit", "3")])


def test_threshold_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id long, url string, html string")
    folder = new_folder(spark, "t")
    warc.write_archives(pages, folder, min_bytes=4)
    assert {r.kind for r in warc.read_records(spark, folder).collect()} == {"request", "response", "metadata"}
    folder = new_folder(spark, "t")
    warc.write_archives(pages.limit(0), folder)
    assert warc.read_records(spark, folder).count() == 0


def test_query_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first, want = {}, []
    for p in sorted(pages, key=lambda p: p.page_id):
        data = (p.html or "").encode()
        d = base64.b32encode(hashlib.sha1(data).digest()).decode()
        seen = first.setdefault(d, p.page_id)
        want.append((p.page_id, len(data), d, "response" if seen == p.page_id else "revisit", None if seen == p.page_id else seen))
    got = sorted(tuple(r) for r in warc.op10_warc(spark, sf).collect())
    assert got == want


def test_files_are_bounded_by_bytes_and_large_pages_pass(spark):
    rng = random.Random(1)
    noise = lambda n: base64.b64encode(rng.randbytes(n * 3 // 4)).decode()
    rows = [(k, f"http://h/{k}", noise(20_000)) for k in range(30)] + [(99, "http://large", noise(50_000_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = new_folder(spark, "t")
    warc.write_archives(pages, folder, file_bytes=100_000)
    sizes = sorted(os.path.getsize(f) for f in glob.glob(folder.removeprefix("file://").removeprefix("file:") + "/part-*"))
    assert len(sizes) >= 6 and all(n <= 100_001 for n in sizes[:-1]) and sizes[-1] > 30_000_000
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read_records(spark, folder).where("kind = 'response'").collect()}
    assert got == {str(i): (len(h), warc.sha1_base32(h.encode())) for i, _, h in rows}


def test_every_record_is_a_member_of_a_valid_gzip_file(spark):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x")], "page_id long, url string, html string").coalesce(1)
    folder = new_folder(spark, "t")
    warc.write_archives(pages, folder)
    found = [open(f, "rb").read() for f in glob.glob(folder.removeprefix("file://").removeprefix("file:") + "/part-*")]
    assert sum(len(list(warc.members(d))) for d in found) == 6
    text = b"".join(map(gzip.decompress, found))
    assert text.count(b"WARC/1.1\r\n") == 6 and text.count(b"WARC-Refers-To: <urn:page:1:") == 1
    # What the revisit refers to is the response's record.
    refers = re.search(rb"WARC-Refers-To: (<[^>]*>)", text)[1]
    assert b"WARC-Type: response\r\nWARC-Record-ID: " + refers in text


def test_malformed_records_are_reported_and_the_rest_is_read(spark, tmp_path):
    good = warc.transaction(5, "http://a", warc.hashlib.sha1(b"hi").hexdigest(), 2, 0, "hi", None, None)
    bad = [b"no record at all", good[1].replace(b"Content-Length: 2\r\n\r\nhi", b"Content-Length: 2\r\n\r\nho"), good[0][:-3], b"WARC/1.1\r\nx: y", b"WARC/1.1\r\nContent-Length: \xc2\xb2\r\n\r\n"]
    whole = b"".join(map(warc.member, [*good, *bad]))
    (tmp_path / "part-0").write_bytes(whole + b"\0")
    (tmp_path / "part-1").write_bytes(warc.member(good[2]) + warc.member(good[0])[:-9])
    (tmp_path / "part-2").write_bytes(b"")
    (tmp_path / "other.warc.gz").write_bytes(warc.member(good[0]))
    records = warc.read_records(spark, f"file://{tmp_path}")
    assert Counter(r.kind for r in records.collect()) == Counter(request=1, response=1, metadata=2, malformed=6)
    assert {r.capture_id for r in warc.assemble(records).collect()} == {f"{warc.record_name(5, 'http://a', warc.hashlib.sha1(b'hi').hexdigest(), 0)}:response"}
    assert warc.read_records(spark, f"file://{tmp_path}", pattern="*.warc.gz").count() == 1
