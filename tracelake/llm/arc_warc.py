"""Conversion of legacy ARC archives to WARC, with payloads stored once.

An ARC file starts with a version block (``filedesc:``) whose second line names the version and whose third line lists
the fields of the one-line record headers that follow: five fields in version 1, ten in version 2. Each header ends
with the length of its record, which is how records are told apart, whatever bytes they hold. The converter parses
these, and makes for each record the WARC identifier (a name-based UUID of place and content), date, type and digests.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest key is stored in full
(``response``); the others become ``revisit`` records that name it and carry its digest. Which one is kept is found by
a partial aggregation on the payload digest, so a payload that a third of all pages share is one row per task. Records
are parsed once and written, compressed; only digests that occur more than once are joined with them.

WARC files are written through Spark's text writer, so any file system works: each row is a run of gzip members (one
per record, as the format recommends), closed by an empty member whose last byte is the writer's line separator. They
are read back with Spark's ``binaryFile`` reader, record by record.

Columns besides key, url and payload are ignored, whatever their names. A payload is held whole, and a file of
``SEGMENT_BYTES`` or of one longer payload at a time.

Nulls: a null payload counts as empty, a null url as ``urn:none``; a null key is kept and never refers or is referred
to unless all keys of a payload are null, in which case all are responses. Rows that repeat the largest key of a
payload are all responses. An empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import column, texts
from tracelake.llm.skew import skew_join
from tracelake.runtime import Scratch, ship_package

MIN_REVISIT = 1000
SEGMENT_BYTES = 4_000_000
ROWS_PER_FILE = 16
BROADCAST_BYTES = 64 << 20
#: Field lists of the two header versions (fixed values).
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
KEY_HEADER = b"X-Page-Id"
DATE = "20240101000000"
RECORDS = "page_id long, url string, ip string, date string, mime string, status int, payload_bytes long, sha1 string, packed binary"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


EMPTY_MEMBER = _gzip(b"")


# --- ARC ------------------------------------------------------------------------------------------------------------


def _safe_url(url: str | None) -> bytes:
    """Header fields are separated by spaces, so those and line ends are percent-encoded."""
    out = (url or "urn:none").encode()
    return b"".join(b"%%%02X" % c if c <= 0x20 or c == 0x7F else bytes([c]) for c in out)


def arc_version_block(version: int, name: str = "pages.arc") -> bytes:
    body = b"%d 0 converter\n%s\n" % (version, FIELDS[version])
    url = b"filedesc://" + name.encode()
    if version == 1:
        return b"%s 0.0.0.0 %s text/plain %d\n%s\n" % (url, DATE.encode(), len(body), body)
    return b"%s 0.0.0.0 %s text/plain 200 - - 0 %s %d\n%s\n" % (url, DATE.encode(), name.encode(), len(body), body)


def arc_record(version: int, key: int | None, url: str | None, payload: bytes, offset: int = 0) -> bytes:
    """One archived HTTP response; the key rides in the response's headers, as ARC has no field for it."""
    named = b"" if key is None else b"%s: %d\r\n" % (KEY_HEADER, key)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), named) + payload
    head = b"%s 0.0.0.0 %s text/html" % (_safe_url(url), DATE.encode())
    if version == 2:
        head += b" 200 %s - %d pages.arc" % (hashlib.md5(payload).hexdigest().encode(), offset)
    return b"%s %d\n%s\n" % (head, len(http), http)


def parse_arc(data: bytes) -> Iterator[dict[str, bytes | int]]:
    """Records of an ARC file after its version block: header fields by name, and ``block``, the declared bytes."""
    end = data.index(b"\n")
    first = data[:end].split(b" ")
    if not first[0].startswith(b"filedesc:"):
        raise ValueError("not an ARC file: no version block")
    length = int(first[-1])
    lines = data[end + 1 : end + 1 + length].split(b"\n")
    version = int(lines[0].split(b" ")[0])
    names = lines[1].decode().split(" ") if len(lines) > 1 and lines[1] else FIELDS[version].decode().split(" ")
    at = end + 1 + length
    while at < len(data):
        if data[at] == 0x0A:  # the line end after a record
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].split(b" ")
        if len(values) != len(names):
            raise ValueError(f"a version {version} header has {len(names)} fields, not {len(values)}")
        record: dict[str, bytes | int] = dict(zip(names, values))
        length = int(values[-1])
        if end + 1 + length > len(data):
            raise ValueError("a record is shorter than it declares")
        record["block"] = data[end + 1 : end + 1 + length]
        record["version"] = version
        yield record
        at = end + 1 + length


def split_http(block: bytes) -> tuple[int, dict[bytes, bytes], bytes]:
    """Status, headers (lower-case names) and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    status = int(lines[0].split(b" ")[1]) if lines[0].startswith(b"HTTP/") else 0
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    return status, headers, payload


def pages_to_arc(pages: DataFrame, version: int | None = None, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``arc``: whole ARC files of up to ``SEGMENT_BYTES`` of payload. Without a version the two alternate."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, out, size = 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal made, out, size
            made += 1
            done = b"".join(out)
            out, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([done], pa.binary())], ["arc"])

        for batch in batches:
            for k, u, body in zip(column(batch, "k").to_pylist(), column(batch, "u").to_pylist(), texts(batch, "p")):
                v = version or 1 + made % 2
                if not out:
                    out.append(arc_version_block(v))
                    size = len(out[0])
                out.append(arc_record(v, k, u, body, size))
                size += len(out[-1])
                if size >= SEGMENT_BYTES:
                    yield close()
        if out:
            yield close()

    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.col(payload).cast("binary").alias("p"))
    return rows.mapInArrow(run, "arc binary")


def read_arc(arcs: DataFrame) -> DataFrame:
    """Records of whole ARC files (column ``arc``): key, header fields, digest, and the HTTP response, compressed."""
    ship_package(arcs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for data in texts(batch, "arc"):
                rows: list[tuple] = []
                for r in parse_arc(data):
                    status, headers, payload = split_http(r["block"])
                    key = headers.get(KEY_HEADER.lower())
                    rows.append(
                        (
                            None if key is None else int(key), r["URL"].decode(), r["IP-address"].decode(), r["Archive-date"].decode(), r["Content-type"].decode(),
                            int(r.get("Result-code", status)), len(payload), hashlib.sha1(payload).hexdigest(), pack(r["block"]),
                        )
                    )
                yield _batch(rows, RECORDS)

    return arcs.select("arc").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


# --- WARC -----------------------------------------------------------------------------------------------------------


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: int | None, url: str, date: str, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {date} {sha1} {url}')}>"


def base32_digest(sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def warc_record(key: int | None, url: str, ip: str, date: str, sha1: str, block: bytes, kept: dict | None) -> bytes:
    """A response record, or a revisit record (the HTTP headers only) that names the response ``kept``."""
    kind = "response" if kept is None else "revisit"
    if kept is not None:
        block = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, url, date, sha1)}", f"WARC-Date: {warc_date(date)}",
        f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: {base32_digest(sha1)}",
        f"WARC-Block-Digest: {base32_digest(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http; msgtype=response",
    ]
    if kept is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(kept['page_id'], kept['url'], kept['date'], sha1)}", f"WARC-Refers-To-Target-URI: {kept['url']}",
            f"WARC-Refers-To-Date: {warc_date(kept['date'])}", f"X-Refers-To-Page-Id: {kept['page_id']}",
        ]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def warc_info(first: bytes) -> bytes:
    """The record that opens a file; its identifier comes from the file's first record."""
    block = b"software: tracelake converter\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_OID, hashlib.sha1(first).hexdigest())
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {warc_date(DATE)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        at = start + int(head["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where it declares")
        yield head, data[start:at]
        at += 4


def gunzip_members(data: bytes) -> Iterator[bytes]:
    """Each gzip member of a file, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            step = view[at : at + 16_384]  # a short step, as the bytes after the member's end are handed back as a copy
            out.append(d.decompress(step))
            at += len(step)
        at -= len(d.unused_data)
        if whole := b"".join(out):
            yield whole


def choose_responses(records: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """``records`` with ``kept``: null for responses, else key, url and date of the response with the same payload.

    ``records`` is read more than once, so it had better be written. Repeated digests are broadcast while what is told
    of them takes at most ``BROADCAST_BYTES``, which is summed first, and records stay where they are; beyond it they
    meet by digest, and frequent digests still stay (see ``skew_join``).
    """
    long_ones = records.where(F.col("payload_bytes") >= least).select("sha1", F.struct("page_id", "url", "date").alias("x"))
    groups = long_ones.groupBy("sha1").agg(F.max("x").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept.page_id is not null")
    size = groups.agg(F.sum(F.octet_length("kept.url") + F.lit(200)).cast("long")).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = records.join(F.broadcast(groups.drop("n")), "sha1", "left")
    else:
        joined = skew_join(records, groups.drop("n"), ["sha1"], "left", counts=groups.select("sha1", "n"))
    other = (F.col("payload_bytes") >= least) & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept.page_id"))
    return joined.withColumn("kept", F.when(other, F.col("kept")))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of records (see ``RECORDS``) with ``kept``, under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        out: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal out, size
            done = b"".join([*out, EMPTY_MEMBER])[:-1]  # the separator that the writer adds is the member's last byte
            out, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([done], pa.binary())], ["data"])

        for batch in batches:
            for r in batch.to_pylist():
                made = warc_record(r["page_id"], r["url"], r["ip"], r["date"], r["sha1"], unpack(r["packed"]), r["kept"])
                if not out:
                    out.append(_gzip(warc_info(made)))
                out.append(_gzip(made))
                size += len(out[-1])
                if size >= SEGMENT_BYTES:
                    yield close()
        if out:
            yield close()

    segments = records.select("page_id", "url", "ip", "date", "sha1", "packed", "kept").mapInArrow(run, "data binary")
    segments.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path`` (see ``RESULT``); digests are checked on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in texts(batch, "content"):
                records = (x for member in gunzip_members(data) for x in parse_warc(member))
                yield _batch([_described(h, b) for h, b in records if h["warc-type"] in ("response", "revisit")], RESULT)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RESULT)


def _described(head: dict[str, str], block: bytes) -> tuple:
    _, http, payload = split_http(block)
    sha1 = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if base32_digest(hashlib.sha1(block).hexdigest()) != head["warc-block-digest"]:
        raise ValueError("a block does not match its digest")
    if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != sha1:
        raise ValueError("a payload does not match its digest")
    key, to = http.get(KEY_HEADER.lower()), head.get("x-refers-to-page-id")
    return (None if key is None else int(key), int(http[b"content-length"]), sha1, head["warc-type"], None if to is None else int(to))


def convert(arcs: DataFrame, path: str, least: int = MIN_REVISIT) -> None:
    """ARC files (column ``arc``) to WARC files under ``path``."""
    spark = arcs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "records")
    records = scratch.keep(read_arc(arcs), "records")  # parsed once, read for the digests and again for the files
    write_warc(choose_responses(records, least), path)
    scratch.drop(records)


def archive_pages(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """Pages written as ARC, converted to WARC in the shared folder, and read back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = scratch.path("warc")
    convert(pages_to_arc(pages), path, least)
    return read_warc(spark, path)


