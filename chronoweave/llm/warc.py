"""WARC archives: one request, response (or revisit) and metadata record per page, written as gzipped
WARC/1.1 files, read back and assembled into one nested row per capture.

Writing. The payload's digest decides the record type: among pages with equal payloads of at least
``min_bytes`` bytes the smallest page_id is the response and the others revisit it. Only (page_id,
digest) rows are grouped and joined for that; payloads stay where they are. Every record is a gzip member of its
own, and a file ends before it would have more than ``file_bytes`` bytes (a larger transaction is a file of its
own), so files are bounded by bytes whatever the pages. The write goes through Spark's commit protocol, and a
lost executor's task is simply run again. Spark's writer ends a file with a zero byte, which gzip allows as
padding.

Reading. A file is read member by member: a worker holds the compressed file and one record at a time, and hands
rows on in batches of bounded size. Records are parsed by Content-Length, and those of one transaction are joined
through WARC-Concurrent-To: request and metadata records name the response's record id. Each capture becomes one
row with nested request, response and metadata. A member that is no record, a response whose payload is not
that of its digest, and a file that is damaged from some byte on give a row of kind ``malformed`` with the reason,
and are in no capture; ``read_records`` shows them to be counted.

Cases: null html is an empty payload; a null url is written as an empty target; rows with equal
page_id give a capture each (record ids carry the url's and payload's digests and a copy number), and
a null page_id counts as larger than every other one; an empty table gives an archive without records; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, new_folder

#: A fixed capture time: the pages carry none, and archives are the same on every run.
DATE = "2020-01-01T00:00:00Z"
#: Compressed bytes of a file, and bytes of the rows that a reader hands on together.
FILE_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
STEP_BYTES = 16 << 10
PAYLOAD_TYPE = "application/http;msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _keyed(pages: DataFrame) -> DataFrame:
    """key (page_id as text, empty if null), page_id, url, html, sha1, payload_bytes: no nulls but page_id's."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"), F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("payload_bytes"),
    )


def decide(pages: DataFrame, min_bytes: int) -> DataFrame:
    """key, url, sha1 and the response's page_id and url, for the pages whose payload others have too."""
    narrow = _keyed(pages).where(F.col("payload_bytes") >= min_bytes).drop("html")
    narrow = narrow.groupBy("key", "page_id", "url", "sha1").agg(F.count("*").alias("rows"))
    first = narrow.groupBy("sha1").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "key")).alias("first"), F.sum("rows").alias("pages"))
    first = first.where("pages > 1").select("sha1", F.col("first.page_id").alias("first_id"), F.col("first.key").alias("first_key"), F.col("first.url").alias("first_url"))
    return narrow.join(first, "sha1").select("key", "url", "sha1", "first_id", "first_key", "first_url")


def record(kind: str, record_id: str, headers: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers] + [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + END.encode() + block


def record_name(page, url: str, sha1: str, copy: int) -> str:
    return f"urn:page:{page}:{hashlib.sha1(url.encode('utf-8', 'replace')).hexdigest()[:16]}:{sha1}:{copy}"


def transaction(page, url: str, sha1: str, n: int, copy: int, html: str | None, first, first_record: str | None) -> list[bytes]:
    """The request, response (html given) or revisit, and metadata records of one page."""
    name = record_name(page, url, sha1, copy)
    main = f"{name}:response"
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Target-URI", target), ("WARC-Page-ID", str(page))]
    joined = [*common, ("WARC-Concurrent-To", f"<{main}>")]
    host = target.partition("://")[2].split("/")[0]
    request = f"GET {target} HTTP/1.1\r\nHost: {host}{END}".encode("utf-8", "replace")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}{END}".encode()
    held = [*common, ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())]
    if html is None:
        held += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{first_record}>"), ("WARC-Refers-To-Page-ID", str(first))]
        answer = record("revisit", main, held, PAYLOAD_TYPE, head)
    else:
        answer = record("response", main, held, PAYLOAD_TYPE, head + html.encode("utf-8", "replace"))
    return [
        record("request", f"{name}:request", joined, "application/http;msgtype=request", request), answer,
        record("metadata", f"{name}:metadata", joined, "application/warc-fields", f"payload-bytes: {n}\r\n".encode()),
    ]


def member(data: bytes) -> bytes:
    """A record as a gzip member, with the blank lines that end it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.compress(END.encode()) + packer.flush()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write the pages as WARC files under the folder."""
    keys = ["key", "url", "sha1"]
    texts = _keyed(pages).groupBy(*keys).agg(
        F.first("page_id").alias("page_id"), F.first("html").alias("html"), F.first("payload_bytes").alias("payload_bytes"), F.count("*").cast("long").alias("copies"))
    rows = texts.join(decide(pages, min_bytes), keys, "left")
    shared = F.col("first_key").isNotNull()
    own = shared & (F.col("key") == F.col("first_key")) & (F.col("url") == F.col("first_url"))
    rows = rows.select(
        "page_id", "url", "sha1", "payload_bytes", "copies", "first_id", "first_url",
        F.when(shared, F.when(own, 1).otherwise(0)).otherwise(F.col("copies")).cast("long").alias("responses"),
        F.when(~shared | own, F.col("html")).alias("html"),
    )
    out = pa.schema([("value", pa.binary())])

    def files(batches):
        held, size = [], 0
        for b in batches:
            for page, url, sha1, n, copies, first, first_url, responses, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "sha1", "payload_bytes", "copies", "first_id", "first_url", "responses", "html"))):
                first_record = None if first_url is None else f"{record_name(first, first_url, sha1, 0)}:response"
                for copy in range(copies):
                    made = [member(r) for r in transaction(page, url, sha1, n, copy, html if copy < responses else None, first, first_record)]
                    more = sum(map(len, made))
                    if held and size + more > file_bytes:
                        yield batch(out, value=[b"".join(held)])
                        held, size = [], 0
                    held += made
                    size += more
        if held:
            yield batch(out, value=[b"".join(held)])

    # A row is a file's content.
    contents = rows.mapInArrow(files, "value binary").select(F.expr("cast(value as string)").alias("value"))
    contents.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


def members(data: bytes):
    """The unpacked gzip members of a file, one at a time; zeros after them are padding. A damaged member ends
    the file, with an exception in its place."""
    view, at = memoryview(data), 0
    while at < len(data) and data[at]:
        unpacker, parts = zlib.decompressobj(31), []
        try:
            while not unpacker.eof:
                if at == len(data):
                    raise zlib.error("the last member ends early")
                parts.append(unpacker.decompress(view[at : at + STEP_BYTES]))
                at = min(at + STEP_BYTES, len(data))
        except zlib.error as error:
            yield error
            return
        yield b"".join(parts)
        at -= len(unpacker.unused_data)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, with lower-case names, and the block of a record."""
    if not data.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        raise ValueError("headers without an end")
    headers = {}
    for line in data[:stop].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        headers[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or data[stop + 4 + int(length) :] != END.encode():
        raise ValueError("the record does not end where its length says")
    if not headers.get("warc-record-id") or not headers.get("warc-type"):
        raise ValueError("a record without an id or a type")
    return headers, data[stop + 4 : -len(END)]


NAMES = ["record_id", "kind", "concurrent_to", "url", "page_id", "refers_to", "payload_digest", "fields"]


def record_row(data: bytes | Exception, with_payload: bool) -> dict:
    """A record's row, or that of a malformed one."""
    try:
        if isinstance(data, Exception):
            raise ValueError(str(data))
        h, block = parse(data)
        head, _, payload = block.partition(b"\r\n\r\n")
        kind = h["warc-type"]
        full = kind == "response"
        if full and "sha1:" + sha1_base32(payload) != h.get("warc-payload-digest"):
            raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
    except ValueError as error:
        return dict.fromkeys(NAMES) | {"kind": "malformed", "fields": str(error), "payload_bytes": None, "payload": None}
    return {
        "record_id": h["warc-record-id"].strip("<>"), "kind": kind, "concurrent_to": h.get("warc-concurrent-to", "").strip("<>") or None,
        "url": h.get("warc-target-uri"), "page_id": h.get("warc-page-id"), "refers_to": h.get("warc-refers-to-page-id"),
        "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "fields": (block if kind == "metadata" else head).decode("utf-8", "replace"),
        "payload_bytes": len(payload) if full else None, "payload": payload if full and with_payload else None,
    }


def read_records(spark: SparkSession, folder: str, with_payload: bool = False, pattern: str = "part-*") -> DataFrame:
    """One row per record of the archives, files of gzip members whose names fit the pattern; responses have their
    payload's length and digest."""
    schema = pa.schema([(c, pa.string()) for c in NAMES] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def records(batches):
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for data in members(content.as_py()):
                    rows.append(record_row(data, with_payload))
                    size += sum(len(v) for v in rows[-1].values() if isinstance(v, (str, bytes)))
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = ", ".join(f"{c} string" for c in NAMES) + ", payload_bytes long, payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("content")
    return files.mapInArrow(records, ddl)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response and metadata joined by concurrent-to ids."""
    main = records.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "page_id", "url",
        F.struct("kind", "record_id", "refers_to", "payload_digest", "payload_bytes", "payload", "fields").alias("response"),
    )
    side = records.where("concurrent_to is not null")
    request = side.where("kind = 'request'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields").alias("request"))
    metadata = side.where("kind = 'metadata'").select(
        F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields", F.expr("try_cast(regexp_extract(fields, 'payload-bytes: ([0-9]+)', 1) as bigint)").alias("payload_bytes")).alias("metadata"))
    return main.join(request, "capture_id", "left").join(metadata, "capture_id", "left")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    folder = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    captures = assemble(read_records(spark, folder))
    return captures.select(
        F.expr("try_cast(page_id as bigint)").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.expr("try_cast(response.refers_to as bigint)").alias("refers_to"),
    )
