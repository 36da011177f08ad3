"""WARC archives: a writer through Spark, and a reader that salvages damaged ones.

Each record is a gzip member of its own. Spark's text writer puts bytes out as
they are, with a separator after each row; a gzip member of less than 16 MiB
ends in a zero byte, so members go out without it and the separator is that
byte (after a longer one stands an empty member). Archives thus reach any store
that Spark writes, under its commit protocol.

The reader checks members (CRC, length) and records (version line, length,
digest). Where a check fails it searches for the next valid member or version
line, goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import released

VERSION = b"WARC/1.1"
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
_MEMBER = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 14
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes of one archive, which is read as one value; a larger record is an archive of its own.
FILE_BYTES = 16 << 20


def record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def build_record(page: int, url: str | None, kind: str, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no block but tells of its whole payload."""
    block = payload if kind == "response" else b""
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url or "")), ("WARC-Page-ID", str(page)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(length)), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        *([("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Page", str(refers_to))] if kind == "revisit" else []),
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose last byte is zero."""
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = coder.compress(record) + coder.flush()
    return out if out[-1] == 0 else out + member(b"", level)


# ---- reading ---------------------------------------------------------------


def _member_at(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The contents of the valid gzip member that begins here, and where it ends."""
    coder, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not coder.eof:
            if at >= len(data):
                return None
            out.append(coder.decompress(view[at : at + _CHUNK]))
            at = min(len(data), at + _CHUNK)
    except zlib.error:
        return None
    return b"".join(out), at - len(coder.unused_data)


def parse_record(data: bytes, at: int) -> tuple[dict, bytes, int] | None:
    """Headers, block and end of the valid record that begins here."""
    if not (line := _LINE.match(data, at)):
        return None
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        return None
    headers = {}
    for row in data[line.end() : end].split(b"\r\n"):
        if row:
            name, colon, value = row.partition(b":")
            if not colon:
                return None
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return None
    block = data[end + 4 : end + 4 + int(size)]
    past = end + 4 + len(block)
    if len(block) != int(size) or data[past : past + 4] != b"\r\n\r\n":
        return None
    known = headers.get("warc-block-digest", "").partition(":")
    if known[0] == "sha256" and hashlib.sha256(block).hexdigest() != known[2].lower():
        return None
    return headers, block, past + 4


def _plain(data: bytes, base: int, packed: bool):
    """Records and gaps of uncompressed bytes; offsets count from base (of a member: all stand for it)."""
    at = gap = 0
    while at < len(data):
        if found := parse_record(data, at):
            if gap < at:
                yield "gap", (base if packed else base + gap), at - gap, None, None
            headers, block, at = found
            yield "record", base if packed else base + at, len(block), headers, block
            gap = at
        else:
            later = _LINE.search(data, at + 1)
            at = later.start() if later else len(data)
    if gap < len(data):
        yield "gap", (base if packed else base + gap), len(data) - gap, None, None


def salvage(data: bytes):
    """(kind, offset, length, headers, block): valid records in order, and quarantined gaps.

    Works on files of gzip members, on plain files, and on mixtures of both.
    """
    at = gap = 0
    while at < len(data):
        step = None
        if data.startswith(_MEMBER, at):
            if found := _member_at(data, at):
                step = [*_plain(found[0], at, True)], found[1]
        elif found := parse_record(data, at):
            step = [("record", at, len(found[1]), found[0], found[1])], found[2]
        if step:
            if gap < at:
                yield "gap", gap, at - gap, None, None
            yield from step[0]
            at = gap = step[1]
            continue
        packed, line = data.find(_MEMBER, at + 1), _LINE.search(data, at + 1)
        at = min(packed if packed >= 0 else len(data), line.start() if line else len(data))
    if gap < len(data):
        yield "gap", gap, len(data) - gap, None, None


# ---- Spark -----------------------------------------------------------------


def choose_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, refers_to (null: a response) and html (null for
    revisits), for each row.

    Digests and lengths are found where the rows are. The least page_id of each
    digest comes from an aggregation, which Spark combines before its shuffle;
    rows meet it in a join that can split a frequent digest. Html crosses the
    shuffle compressed as the record that it may become. Null html is empty; rows
    without page_id, and payloads below the least size, are responses. Of equal
    page_ids each row keeps its own role. Columns named as the results clash
    with nothing: only page_id, url and html are read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("payload_digest"))
    first = rows.where(f"payload_bytes >= {LEAST_REVISIT} and page_id is not null").groupBy("payload_digest").agg(F.min("page_id").alias("first_page"))
    packed = rows.mapInArrow(_responses, "page_id long, url string, payload_bytes long, payload_digest string, member binary")
    return packed.join(first, "payload_digest", "left").withColumn("refers_to", F.expr(f"case when payload_bytes >= {LEAST_REVISIT} and page_id > first_page then first_page end"))


def _responses(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            url, digest, page, size = (part.column(c).to_pylist() for c in ("url", "payload_digest", "page_id", "payload_bytes"))
            members = [member(build_record(p, u, "response", h.encode("utf-8", "surrogatepass"), d, n, None)) for p, u, h, d, n in zip(page, url, part.column("html").to_pylist(), digest, size)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("payload_bytes"), part.column("payload_digest"), pa.array(members, pa.binary())], names=["page_id", "url", "payload_bytes", "payload_digest", "member"])


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """One record for each row of pages (page_id, url, html), as gzip members in files below path.

    A null html is an empty payload, a null url an empty address; a row without
    page_id is a response that nothing revisits. Of rows of one page_id and one
    payload each is a record, all of the same kind. An empty table gives no
    archive; further columns, whatever their names, are not read. No file is
    larger than file_bytes, unless one record is.
    """
    ready = choose_roles(pages).select("page_id", "url", "payload_bytes", "payload_digest", F.expr("case when refers_to is null then member end").alias("member"), "refers_to")

    @released
    def pack(batches):
        held, size = [], 0

        def archive():
            # Each member ends in a zero byte, which stands between two of them; the writer adds the last one.
            return pa.RecordBatch.from_arrays([pa.array([b"\x00".join(held)], pa.binary())], names=["value"])

        for batch in batches:
            for page, url, length, digest, packed, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload_bytes", "payload_digest", "member", "refers_to"))):
                if refers is not None:
                    packed = member(build_record(page, url, "revisit", b"", digest, length, refers))
                if held and size + len(packed) > file_bytes:
                    yield archive()
                    held, size = [], 0
                held.append(packed[:-1])
                size += len(packed)
        if held:
            yield archive()

    rows = ready.mapInArrow(pack, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Rows of kind record or gap: file, offset, length, and of records their headers' page_id,
    record_type, payload_bytes, payload_digest, refers_to (and payload). Gaps are the
    quarantined byte ranges of damaged archives. Repeated records are repeated rows; a record without
    a page has a null page_id; no archives give no rows."""
    fields = [("file", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    if payloads:
        fields.append(("payload", pa.binary()))
    schema = pa.schema(fields)

    def number(text):
        return int(text) if text and re.fullmatch(r"-?\d+", text) else None

    @released
    def parse(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for kind, offset, length, headers, block in salvage(data.as_buffer().to_pybytes()):
                    row = {"file": file, "kind": kind, "offset": offset, "length": length}
                    if kind == "record":
                        response = headers.get("warc-type") == "response"
                        row |= {
                            "page_id": number(headers.get("warc-page-id")), "record_type": headers.get("warc-type"), "refers_to": number(headers.get("warc-refers-to-page")),
                            "payload_bytes": len(block) if response else number(headers.get("warc-payload-length")),
                            "payload_digest": hashlib.sha256(block).hexdigest() if response else headers.get("warc-payload-digest", "").partition(":")[2],
                        }
                        if payloads:
                            row["payload"] = block
                    rows.append(row)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "file string, kind string, offset long, length long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payloads else "")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, ddl)
