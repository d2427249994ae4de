"""WARC archives: one gzip member per record, written by task and read back sequentially.

Pages with equal payloads of at least `MIN_REVISIT` bytes share one response, that with the largest
id; the others are revisits that name it. The reader inflates member by member with an incremental
decompressor, frames each record by its content length, and verifies the block and payload digests.
Archives of other writers are read as well: digests may be missing, in base 32 or by another
algorithm (one that is unknown is passed over), and records of other types than response and revisit
are skipped; a body with a transfer encoding isn't held against its payload digest.

Defined results: a null payload is the empty one; below the limit every page is a response; every
record has an id of its own, whatever the page's; a null page id comes back null; pages with one id
are each a record, and of equal ones with the largest id, all are responses. A record of another
writer has a null page_id, a revisit of one a null refers_to and payload_bytes. An empty table gives no
archives. A damaged archive raises `Damaged`.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, key_filter, may_be_in, shared_dir, spread, stored
from .files import opened

MIN_REVISIT = 1000
#: Bytes that the reader takes from a file at a time.
READ_BYTES = 1 << 20
LEVEL = 4
DATE = b"2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENCODED = re.compile(rb"^transfer-encoding:", re.IGNORECASE | re.MULTILINE)
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


class Damaged(ValueError):
    """A record that isn't framed as it says, or whose digest differs."""


class Record(NamedTuple):
    headers: dict[bytes, bytes]
    block: bytes


def encode(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One record as one gzip member."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    uri = lambda url: (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <" + uuid.uuid4().urn.encode() + b">",
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + uri(url),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode(),
        b"X-Payload-Length: %d" % len(payload),
        b"Content-Type: application/http;msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if page_id is not None:
        lines.append(b"X-Page-ID: %d" % page_id)
    if revisit:
        lines += [b"WARC-Profile: " + _REVISIT, b"WARC-Refers-To-Target-URI: " + uri(refers_url), b"WARC-Refers-To-Date: " + DATE, b"X-Refers-To-Page-ID: %d" % refers_to]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def read(file) -> Iterator[Record]:
    """The records of an open archive, one after the other. A cut or damaged one raises Damaged."""
    pending = b""
    while True:
        unpack, parts, ended = zlib.decompressobj(31), [], False
        while not ended:
            if not pending:
                pending = file.read(READ_BYTES)
                if not pending:
                    if parts:
                        raise Damaged("the last member is cut")
                    return
            try:
                parts.append(unpack.decompress(pending))
            except zlib.error as error:
                raise Damaged(str(error)) from error
            ended, pending = unpack.eof, unpack.unused_data
        yield _record(b"".join(parts))


def _record(raw: bytes) -> Record:
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise Damaged("no WARC header")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(b":") for line in lines[1:])}
    length = _number(headers, b"content-length")
    if length is None or rest[length:] != b"\r\n\r\n":
        raise Damaged("the content length doesn't end the record")
    block = rest[:length]
    _verify(headers.get(b"warc-block-digest"), block, "block")
    return Record(headers, block)


def _number(headers: dict[bytes, bytes], name: bytes) -> int | None:
    if name in headers and not headers[name].isdigit():
        raise Damaged(f"{name.decode()} isn't a number")
    return int(headers[name]) if name in headers else None


def _verify(said: bytes | None, data: bytes | memoryview, what: str) -> None:
    """Hold data against a digest, `algorithm:value`, hexadecimal or in base 32; none proves nothing."""
    name, _, value = (said or b"").decode(errors="replace").partition(":")
    name = name.lower().replace("-", "")
    if not value or name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return
    made = hashlib.new(name, data).digest()
    if value.lower() != made.hex() and value.upper().rstrip("=") != base64.b32encode(made).decode().rstrip("="):
        raise Damaged(f"the {what} digest differs")


def _row(record: Record) -> tuple | None:
    """The columns of SCHEMA; None for records that aren't of a page."""
    headers = record.headers
    kind = headers.get(b"warc-type", b"").decode(errors="replace")
    if kind not in ("response", "revisit"):
        return None
    said, length = headers.get(b"warc-payload-digest"), _number(headers, b"x-payload-length")
    page, refers, url = _number(headers, b"x-page-id"), _number(headers, b"x-refers-to-page-id"), headers.get(b"warc-target-uri", b"").decode(errors="replace")
    if kind == "response":
        http, _, payload = record.block.partition(b"\r\n\r\n")
        if not _ENCODED.search(http):
            _verify(said, payload, "payload")
        if length is not None and length != len(payload):
            raise Damaged("the payload's length differs")
        return page, len(payload), hashlib.sha1(payload).hexdigest(), kind, None, url
    return page, length, (said or b"").rpartition(b":")[2].decode(errors="replace") or None, kind, refers, url


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """page_id, url, payload, digest and, for revisits, refers_to and refers_url of their response (else
    null). Only digests are grouped. Those that occur twice go to the payloads if they are few enough;
    of more, a filter goes, and only payloads that pass it are joined by digest, whose hot values
    adaptive execution splits."""
    folder = folder or shared_dir(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= MIN_REVISIT
    last = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))), "url"))
    twins = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("last"), last["url"].alias("last_url"), F.count("*").alias("n")).where("n > 1")
    twins = stored(twins.drop("n"), f"{folder}/twins")
    refers = long & (F.coalesce("page_id", F.lit(-1)) != F.col("last"))
    columns = ["page_id", "url", "payload", "digest", F.when(refers, F.col("last")).alias("refers_to"), F.when(refers, F.col("last_url")).alias("refers_url")]
    if twins.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(twins), "digest", "left").select(*columns)
    keyed = rows.withColumn("key", F.when(long, F.xxhash64("digest")))
    maybe = may_be_in(key_filter(twins.select(F.xxhash64("digest"))), F.col("key"), pages.sparkSession) & F.col("key").isNotNull()
    alone = keyed.where(~maybe).withColumns({"last": F.lit(None).cast("long"), "last_url": F.lit(None).cast("string")})
    return alone.select(*columns).union(keyed.where(maybe).join(twins, "digest", "left").select(*columns))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of `deduplicated`, an archive per task, and return file and records. Computing
    it writes the archives, so store it once; of tasks run again, only the committed file counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, n = None, 0
        try:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url"))):
                    out = out or opened(name, "w")
                    out.write(encode(*(x.as_py() for x in row)))
                    n += 1
        finally:
            if out:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "file string, records long")


def scan(files: DataFrame) -> DataFrame:
    """The rows of SCHEMA of the pages in `files` (column file), archives that one task each reads."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with opened(name) as file:
                    rows = filter(None, map(_row, read(file)))
                    while part := list(islice(rows, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), types)], names)

    return spread(files.select("file"), files.count(), "file").mapInArrow(run, SCHEMA)
