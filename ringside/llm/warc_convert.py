"""Operator 7, WARC: legacy archive converter.

Pages are framed as records of ARC archives, version 1 or 2. The converter reads an archive by the declared lengths in
its version-specific header lines (never by searching for the next record), and synthesises the equivalent WARC/1.1
records: identifiers that depend only on the record, timestamps from the archive date, types, payload digests and
lengths. Records whose payloads are equal and long enough become revisits of the one with the largest page_id.

WARC files are written by Spark's text writer to the shared folder, with the record separator as the line separator and
gzip. What it writes as a row is a part of many records of at most ``PART`` bytes together (a longer record is a part of
its own), and a file holds one part, so that files are bounded by bytes. They are read back file by file: inflated a
little at a time, and cut again by declared lengths.

The archive's version block becomes each part's first record, of type warcinfo.

Defined results: null html is an empty payload, null url the empty string; rows with null page_id are written, are
always responses and are never pointed to; rows that repeat a page_id and its payload are equals of each other, not
revisits; line breaks inside a url become %0D and %0A; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.arrays import lean
from ringside.llm.session import scratch_path, small_batches

#: Fixed values of the two ARC versions: the version block's fields.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_DATE = "20240101000000"
#: Bytes of the records that one file holds, before they are compressed; bytes that are inflated at a time.
PART, INFLATED = 32 << 20, 1 << 20
SOFTWARE = "software: ringside\r\nformat: WARC file version 1.1\r\n"
#: Records with shorter payloads are never revisits.
LEAST_PAYLOAD = 1000
PAGE_HEADER = "X-Page-Id"
NO_PAGE = "-"
SEPARATOR = "\r\n\r\n"
RECORDS = "page_id long, record_id string, target_uri string, date string, http string, payload string, payload_bytes long, payload_digest string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    content: bytes
    version: int


def arc_archive(pages: Iterable[tuple[int | None, str | None, str | None]], version: int) -> bytes:
    """Pages (page_id, url, html) as one ARC archive: a version block, then each page's HTTP response."""
    fields = f"{version} 0 Ringside\n{ARC_FIELDS[version]}\n".encode()
    extra = "" if version == 1 else " 200 - - 0 pages.arc"
    out = [f"filedesc://pages.arc 0.0.0.0 {ARC_DATE} text/plain{extra} {len(fields)}\n".encode(), fields, b"\n"]
    for page_id, url, html in pages:
        payload = (html or "").encode()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n{PAGE_HEADER}: {NO_PAGE if page_id is None else page_id}\r\n\r\n".encode()
        where = (url or "").replace("\r", "%0D").replace("\n", "%0A") or NO_PAGE
        out += [f"{where} 0.0.0.0 {ARC_DATE} text/html{extra} {len(http) + len(payload)}\n".encode(), http, payload, b"\n"]
    return b"".join(out)


def parse_arc(archive: bytes) -> Iterator[ArcRecord]:
    """An archive's records without its version block. Lines are split from the right: URLs may hold blanks."""
    at, version = 0, 0
    while at < len(archive):
        end = archive.index(b"\n", at)
        line = archive[at:end].decode("utf-8", "surrogateescape")
        declared = int(line.rpartition(" ")[2])
        content = archive[end + 1 : end + 1 + declared]
        if len(content) != declared:
            raise ValueError(f"the archive ends inside a record of {declared} bytes")
        if not version:
            version = int(content[: content.index(b" ")])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
        else:
            url, ip, date, kind, *_ = line.rsplit(" ", len(ARC_FIELDS[version].split()) - 1)
            yield ArcRecord(url, ip, date, kind, content, version)
        at = end + 1 + declared + 1


def record_id(page_id: int | None, digest: str) -> str:
    """A version-8 UUID that depends only on the page: its id in the first 64 free bits, its payload's digest in the rest."""
    number = (page_id or 0) & (2**64 - 1)
    rest = int(digest[:16], 16) & (2**58 - 1)
    digits = f"{number >> 16:012x}8{(number >> 4) & 0xFFF:03x}{(0b10 << 62) | ((number & 0xF) << 58) | rest:016x}"
    return f"urn:uuid:{digits[:8]}-{digits[8:12]}-{digits[12:16]}-{digits[16:20]}-{digits[20:]}"


def page_of(uri: str) -> int:
    """The page_id in a record's identifier."""
    digits = uri.rpartition(":")[2].replace("-", "")
    number = int(digits[:12], 16) << 16 | int(digits[13:16], 16) << 4 | (int(digits[16:], 16) >> 58) & 0xF
    return number - 2**64 if number >= 2**63 else number


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _convert(version: int):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                pages = zip(*(c.slice(i, 256).to_pylist() for c in batch.columns), strict=True)
                rows = []
                for r in parse_arc(arc_archive(pages, version)):
                    http, _, payload = r.content.partition(b"\r\n\r\n")
                    page = http.rpartition(f"{PAGE_HEADER}: ".encode())[2].decode()
                    page_id = None if page == NO_PAGE else int(page)
                    digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
                    rows.append((page_id, record_id(page_id, digest), r.url, warc_date(r.date), http.decode(), payload.decode(), len(payload), digest))
                if rows:
                    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return run


def converted(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages through an ARC archive of that version to the parts of WARC records."""
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(lean(_convert(version)), RECORDS)


def with_revisits(records: DataFrame, pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """The records with ``holder``, the page that a revisit points to (null for responses).

    Equal payloads are found by digest over all pages, without their texts, and what is found meets the records by page.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    short = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    long = short.where(F.col("page_id").isNotNull() & (F.col("size") >= least))
    held = long.groupBy("digest").agg(F.max("page_id").alias("holder"), F.min("page_id").alias("first")).where("first < holder")
    # The digest is computed anew, so that Spark may split the partition of a payload that very many pages have.
    held = held.select(F.concat("digest", F.lit("")).alias("of"), "holder")
    again = long.join(held, F.col("digest") == F.col("of")).where("page_id < holder").select(F.col("page_id").alias("page"), "digest", "holder").distinct()
    named = records.where("page_id is not null")
    joined = named.join(again, (named["page_id"] == again["page"]) & (named["payload_digest"] == again["digest"]), "left").drop("page", "digest")
    return joined.unionByName(records.where("page_id is null").withColumn("holder", F.lit(None).cast("long")))


def warc_record(kind: str, head: list[str], block: str, content_type: str) -> str:
    """A record without the separator that ends it."""
    length = len(block.encode())
    return "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", *head, f"Content-Type: {content_type}", f"Content-Length: {length}"]) + SEPARATOR + block


def _frame(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as text, many of them in a row, each but the last with the separator that ends it."""
    info: list[str] = []
    held: list[str] = []
    size = 0

    def part() -> pa.RecordBatch:
        return pa.record_batch([pa.array([SEPARATOR.join(info + held)], pa.large_string()).cast(pa.string())], ["value"])

    for batch in batches:
        for _, own, uri, date, http, payload, length, digest, holder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            head = [f"WARC-Record-ID: <{own}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {length}"]
            if holder is not None:
                head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(holder, digest)}>"]
            block = http + SEPARATOR + ("" if holder is not None else payload)
            record = warc_record("response" if holder is None else "revisit", head, block, "application/http;msgtype=response")
            if held and size + len(block) > PART:
                yield part()
                held, size = [], 0
            if not held:
                number = uuid.uuid5(uuid.NAMESPACE_URL, own)
                info = [warc_record("warcinfo", [f"WARC-Record-ID: <urn:uuid:{number}>", f"WARC-Date: {date}"], SOFTWARE, "application/warc-fields")]
            held.append(record)
            size += len(block)
    if held:
        yield part()


def parse_warc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC file that comes in chunks; one record is held at a time."""
    source, held = iter(chunks), bytearray()

    def more() -> bool:
        chunk = next(source, None)
        if chunk is None:
            return False
        held.extend(chunk)
        return True

    while held or more():
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise ValueError("a WARC file ends inside a record's headers")
        version, *lines = held[:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record where one should begin: {version[:40]!r}")
        head = dict(x.split(": ", 1) for x in lines)
        begin, size = end + 4, int(head["Content-Length"])
        while len(held) < begin + size + 4:
            if not more():
                raise ValueError(f"a WARC file ends inside a record of {size} bytes")
        if held[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end at its declared length")
        yield head, bytes(held[begin : begin + size])
        del held[: begin + size + 4]


def inflated(content: bytes) -> Iterator[bytes]:
    """The members of a gzip file, a bounded number of bytes at a time."""
    while content:
        one = zlib.decompressobj(wbits=31)
        while not one.eof:
            chunk = one.decompress(content, INFLATED)
            content = one.unconsumed_tail
            if chunk:
                yield chunk
            elif not content and not one.eof:
                raise ValueError("a gzip member ends early")
        content = one.unused_data


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in parse_warc(inflated(content.as_py())):
                if head["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                page = http.rpartition(f"{PAGE_HEADER}: ".encode())[2].decode()
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
                if head["WARC-Type"] == "response" and (hashlib.sha1(payload, usedforsecurity=False).hexdigest(), len(payload)) != (digest, size):
                    raise ValueError(f"{head['WARC-Record-ID']}: the payload is not the one declared")
                refers = page_of(head["WARC-Refers-To"].strip("<>")) if "WARC-Refers-To" in head else None
                rows.append((None if page == NO_PAGE else int(page), size, digest, head["WARC-Type"], refers))
            if rows:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])


def write_warc(records: DataFrame, path: str) -> None:
    """Records with ``holder`` as gzipped WARC files below a path that all executors share."""
    columns = [x.split()[0] for x in RECORDS.split(", ")]
    framed = records.select(*columns, "holder").mapInArrow(lean(_frame), "value string")
    framed.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read_warc(spark, path: str) -> DataFrame:  # noqa: ANN001
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(lean(_read), READ)


def convert_pages(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages to ARC, to WARC files in the shared folder, and back: what ``read_warc`` finds."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(with_revisits(converted(pages, version), pages), path)
    return read_warc(pages.sparkSession, path)
