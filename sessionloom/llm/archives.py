"""Legacy archives to WARC: ARC files of versions 1 and 2 are parsed and written as equivalent WARC records.

An ARC file begins with a version block, whose own lines name the version and the fields of a header line: five in version
1, ten in version 2. The fields are taken by those names; a record's content has the declared length. From url, date,
content and payload the converter makes what WARC asks for: record identifiers (the same on every run), ISO dates, types,
block and payload digests. Of equal payloads of at least ``least`` bytes, that of the smallest page is written whole and
the others refer to it.

Archives are files of about ``FILE`` bytes, whole by themselves, so that each is read by one task in bounded memory. The
payloads are moved once, by page; which payloads are equal is decided on digests alone, first added up by task.

Contents are bytes throughout: payloads and HTTP heads need not be text in any encoding and come out as they went in.
A record's identifier follows from its archive's name and its place there, so equal rows have different ones.

Defined results: a null html is an empty payload. Rows with equal page ids and payloads are all response or all revisit. A
null page id is no page's reference if the payload has another. Blanks and control characters of a url are escaped; a null
url becomes ``about:blank``. In archives from elsewhere a url may hold blanks: the other fields are counted from the end of
the line. A url that begins with ``filedesc:`` is a page unless its content is a version block. A record shorter than
declared, or before any version block, is an error.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.context import cut, shared_dir
from sessionloom.llm.common import session, table

#: Bytes of an archive, about.
FILE = 8 << 20
#: The fields of ARC header lines by version, and WARC's profile of revisits.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20000101000000"
UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f]")


def arc_record(version: int, page: int | None, url: str | None, html: str | bytes | None, name: str, offset: int) -> bytes:
    """One record: header line, HTTP answer, line end."""
    body = html.encode() if isinstance(html, str) else html or b""
    url = UNSAFE.sub(lambda m: urllib.parse.quote(m.group()), url or "about:blank")
    content = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'-' if page is None else page}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    middle = [] if version == 1 else ["200", "-", "-", str(offset), name]
    return " ".join([url, "0.0.0.0", DATE, "text/html", *middle, str(len(content))]).encode() + b"\n" + content + b"\n"


def arc_head(version: int, name: str) -> bytes:
    block = f"{version} 0 legacy\n{' '.join(FIELDS[version])}\n"
    middle = [] if version == 1 else ["200", "-", "-", "0", name]
    return " ".join([f"filedesc://{name}", "0.0.0.0", DATE, "text/plain", *middle, str(len(block))]).encode() + f"\n{block}\n".encode()


def version_block(content: bytes) -> tuple[str, ...] | None:
    """The field names of a version block; none if it is something else."""
    said = content.split(b"\n")[:2]
    number = said[0].split(b" ")[0]
    names = tuple(said[-1].decode("latin-1").rstrip("\r").split(" "))
    return names if number.isdigit() and names == FIELDS.get(int(number)) else None


def arc_records(raw: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Identity (archive and place), header fields by name, and content, of each record after the version block; blocks may follow each other."""
    at, names, archive = 0, None, ""
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":
            at += 1
            continue
        start, end = at, raw.index(b"\n", at)
        line, at = raw[at:end].decode("utf-8", "replace").rstrip("\r"), end + 1
        size = int(line.rsplit(" ", 1)[1])
        content, at = raw[at : at + size], at + size
        if len(content) < size:
            raise ValueError("an ARC record is shorter than declared")
        if line.startswith("filedesc:"):
            if found := version_block(content):
                names, archive = found, line.split(" ")[0]
                continue
            if names is None:
                raise ValueError(f"unknown ARC version block: {content[:80]!r}")
        fields = line.rsplit(" ", len(names) - 1) if names else []
        if not names or len(fields) != len(names):
            raise ValueError("an ARC header line doesn't fit its version")
        yield f"{archive}#{start}", dict(zip(names, fields, strict=True)), content


def http_parts(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, header fields in lower case, payload."""
    head, gap, payload = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ": " in line)
    return head + gap, {k.lower(): v for k, v in fields.items()}, payload


def record_id(identity: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, identity)}>"


def warc_record(identity: str, fields: dict[str, str], head: bytes, payload: bytes, digest: str, first: int | None, of: str | None) -> bytes:
    """The record equivalent to an ARC record; ``first`` is the page that a revisit refers to, ``of`` its record."""
    d = fields["Archive-date"]
    block = head if first is not None else head + payload
    url = UNSAFE.sub(lambda m: urllib.parse.quote(m.group()), fields["URL"])
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(identity)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {fields['IP-address']}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(of)}", f"X-Refers-To-Page: {first}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def warc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    at = 0
    while (at := raw.find(b"WARC/1.1\r\n", at)) >= 0:
        end = raw.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        at = end + 4 + int(fields["Content-Length"])
        yield fields, raw[end + 4 : at]


def _bundled(make, columns: int):
    """Records as strings of about ``FILE`` bytes; ``make`` gets a row, the archive's name and the offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
                record = make(row, task, f"{task:06d}-{number:06d}", size)
                held.append(record)
                size += len(record)
                if size >= FILE:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    number, held, size = number + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    return run


def _write(bundles: DataFrame, folder: str) -> None:
    """One archive for each string, compressed."""
    # A cast keeps the bytes as they are, and the text writer writes them so.
    bundles.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(folder)


def write_arc(pages: DataFrame, folder: str) -> None:
    """ARC files of ``page_id, url, html``: of version 1 and 2 in turn, by task."""

    def make(row, task, name, size):
        version = 1 + task % 2
        head = b"" if size else arc_head(version, name)
        return head + arc_record(version, *row, name, size or len(head))

    session(pages.sparkSession)
    _write(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_bundled(make, 3), "value binary"), folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")


def _number(text: str | None) -> int | None:
    return None if text in (None, "-") else int(text)


def _parsed(whole: bool):
    """Rows of the ARC records; without ``whole`` only what equal payloads are found by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows: list[tuple] = []
                for identity, fields, content in arc_records(gzip.decompress(raw.as_py())):
                    head, said, payload = http_parts(content)
                    row = (_number(said.get("x-page-id")), hashlib.sha256(payload).hexdigest(), len(payload), identity)
                    rows.append((*row, fields["URL"], fields["IP-address"], fields["Archive-date"], head, payload) if whole else row)
                if rows:
                    types = (pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary())
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types, strict=False)]
                    yield pa.RecordBatch.from_arrays(columns, ["page_id", "digest", "size", "identity", "url", "ip", "date", "head", "payload"][: len(columns)])

    return run


def convert(spark: SparkSession, arc: str, warc: str, least: int = 100) -> None:
    """Write the ARC files in one folder as WARC files in another."""
    session(spark)
    short = cut(_files(spark, arc).mapInArrow(_parsed(False), "page_id long, digest string, size long, identity string"))
    long = short.where(F.col("size") >= least)
    firsts = long.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "identity"))).alias("m"), F.count("*").alias("n")).where("n > 1 AND m IS NOT NULL")
    firsts = firsts.select("digest", F.col("m.page_id").alias("first"), F.col("m.identity").alias("of"))
    revisits = long.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first", "of").distinct()
    whole = _files(spark, arc).mapInArrow(_parsed(True), "page_id long, digest string, size long, identity string, url string, ip string, date string, head binary, payload binary")
    joined = whole.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")

    def make(row, task, name, size):
        identity, digest, url, ip, date, head, payload, first, of = row
        return warc_record(identity, {"URL": url, "IP-address": ip, "Archive-date": date}, head, payload, digest, first, of)

    _write(joined.select("identity", "digest", "url", "ip", "date", "head", "payload", "first", "of").mapInArrow(_bundled(make, 9), "value binary"), warc)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            rows = []
            for fields, block in warc_records(gzip.decompress(raw.as_py())):
                _, said, payload = http_parts(block)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "response":
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload doesn't have its digest")
                    size = len(payload)
                else:
                    size = int(said["content-length"])
                rows.append((_number(said.get("x-page-id")), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], _number(fields.get("X-Refers-To-Page")), payload))
            if rows:
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record; the payload of a revisit is empty."""
    return _files(spark, folder).mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op7_archives(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/archives/{uuid.uuid4().hex}"
    write_arc(table(spark, sf_dir, "pages"), f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc").drop("payload", "url")
