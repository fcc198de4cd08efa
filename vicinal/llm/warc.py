"""WARC archives and the normaliser of monolithic gzip files.

``write_monolithic`` writes pages as WARC 1.1 records, all of a file in a single
gzip stream (as some crawlers do; no record can be read without all before it).
``normalise`` inflates such a stream once, rewrites every record as a gzip
member of its own and writes a sidecar index with the offset and length of
each. ``read`` takes records from a normalised archive by that index.

Of records with equal payloads of ``LEAST_BYTES`` or more, that with the
smallest page id is a response and the others are revisits without a payload.
Edge cases: a null html is an empty payload; a null url is left out; a null
page id has no page header and is a response unless an equal payload has an id;
rows that repeat the smallest page id are all responses; an empty table has no
archives. Columns other than page_id, url and html are not stored, so others
may have any name. A record is held whole, some five times.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import common

#: Payloads below this size are never revisits.
LEAST_BYTES = 100
#: Payload bytes after which a task begins its next file.
FILE_BYTES = 128 << 20
#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"1970-01-01T00:00:00Z"
LEVEL, CHUNK = 4, 1 << 20
#: Parts in which the copies of one page are dealt.
SALTS = 16
INDEX = "file string, offset long, length long, page_id long, record_type string"


def urn(page_id: int | None) -> bytes:
    return b"<urn:page:%d>" % page_id if page_id is not None else b"<urn:uuid:%s>" % str(uuid.uuid4()).encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (``refers_to``) keeps the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + urn(page_id), b"WARC-Date: " + DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url).encode())
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + urn(refers_to), b"WARC-Profile: " + PROFILE]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(file) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in chunks."""
    z = zlib.decompressobj(31)
    while data := file.read(CHUNK):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
    yield z.flush()


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names lower case) and all bytes of each record; memory
    holds one record."""
    held = bytearray()
    at_end = False

    def more() -> bool:
        nonlocal at_end
        part = next(chunks, None)
        at_end = part is None
        held.extend(part or b"")
        return not at_end

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError("the archive ends inside a record")
            return
        head = parsed(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(held[:size])
        del held[:size]


def parsed(head: bytes) -> dict[str, str]:
    first, *rest = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record begins here")
    return {k.strip().decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in rest)}


def page_of(uri: str | None) -> int | None:
    return int(uri[10:-1]) if uri and uri.startswith("<urn:page:") else None


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= LEAST_BYTES, F.col("digest")))
    # who refers to whom is found without the payloads; copies of a hot page are salted
    narrow = rows.where(F.col("key").isNotNull()).groupBy("page_id", "key").agg(F.count("*").alias("n"))
    again = narrow.groupBy("key").agg(F.min("page_id").alias("first_id"), F.sum("n").alias("n")).where("n > 1").select("key", "first_id")
    salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    refers = narrow.withColumn("salt", F.coalesce(F.pmod("page_id", F.lit(SALTS)), F.lit(0)).cast("int")).join(salted, ["key", "salt"])
    refers = refers.where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(F.col("page_id").alias("of"), F.col("key").alias("held"), F.col("first_id").alias("refers_to"))
    # rows meet it by page, so no payload decides where a row goes
    out = rows.join(refers, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("held")), "left")
    return out.select("page_id", "url", "html", "digest", "refers_to")


def write_monolithic(pages: DataFrame, uri: str) -> DataFrame:
    """Write ``with_types`` rows to files below ``uri``, each one gzip stream.
    Returns a stored manifest: file, n_records. Files of failed attempts are in
    no manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(uri)
        fs.create_dir(root, recursive=True)
        out, z, name, n, size = None, None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": [n]})

        for batch in batches:
            for piece in common.slices(batch, "html"):
                html = common.values(piece, "html")
                for page, url, body, digest, refers in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), html, piece.column(3).to_pylist(), piece.column(4).to_pylist(), strict=True):
                    if out is None:
                        name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out, z = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out.write(z.compress(record(page, url, body, digest, refers)))
                    n, size = n + 1, size + len(body)
                    if size >= FILE_BYTES:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return common.stored(pages.mapInArrow(run, "file string, n_records long"), "archives")


def normalise(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each file of ``manifest`` (below ``source``) as one gzip member a
    record below ``target``, with a sidecar ``.idx`` of JSON lines. Returns a
    stored manifest: file (the normalised one), n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(source)
        to, into = common.filesystem(target)
        to.create_dir(into, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new, at, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f, to.open_output_stream(f"{into}/{new}", compression=None) as out, to.open_output_stream(f"{into}/{new}.idx", compression=None) as index:
                    for head, data in records(inflated(f)):
                        packed = member(data)
                        out.write(packed)
                        line = {"offset": at, "length": len(packed), "id": head.get("warc-record-id"), "type": head.get("warc-type"), "uri": head.get("warc-target-uri")}
                        index.write(json.dumps(line).encode() + b"\n")
                        at, n = at + len(packed), n + 1
                yield pa.RecordBatch.from_pydict({"file": [new], "n_records": [n]})

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return common.stored(manifest.select("file").repartition(parts).mapInArrow(run, "file string, n_records long"), "archives")


def index(manifest: DataFrame, uri: str) -> DataFrame:
    """The rows of the sidecar indexes of normalised archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}.idx", compression=None) as f:
                    rows = [json.loads(x) for x in f.read().splitlines()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r["offset"] for r in rows], pa.int64()), pa.array([r["length"] for r in rows], pa.int64()), pa.array([page_of(r["id"]) for r in rows], pa.int64()), pa.array([r["type"] for r in rows], pa.string())], names=["file", "offset", "length", "page_id", "record_type"])

    return manifest.select("file").mapInArrow(run, INDEX)


def read(found: DataFrame, uri: str) -> DataFrame:
    """Read the records of ``index`` rows (any of them), each by its offset:
    page_id, url, record_type, refers_to, payload_bytes, payload_digest (of the
    bytes that were read; a revisit's from its header) and payload (binary, null
    for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(uri)
        name, file = None, None
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            size = 0
            for own, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != name:
                    if file is not None:
                        file.close()
                    name, file = own, fs.open_input_file(f"{root}/{own}")
                file.seek(at)
                data = zlib.decompress(file.read(n), 31)
                end = data.index(b"\r\n\r\n")
                head = parsed(data[:end])
                block = data[end + 4 : end + 4 + int(head["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                revisit = head["warc-type"] == "revisit"
                full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = head["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha256(payload).hexdigest()
                row = (page_of(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], page_of(head.get("warc-refers-to")), full if revisit else len(payload), digest, None if revisit else payload)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                size += len(payload)
                if size > common.SLICE_BYTES:
                    yield _rows(cols)
                    cols, size = [[] for _ in range(7)], 0
            yield _rows(cols)
        if file is not None:
            file.close()

    return found.select("file", "offset", "length").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _rows(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
