"""WARC archives of pages: written by tasks, read back sequentially.

Every record is a gzip member of its own.  The reader takes a file in small chunks, inflates one member at a time, frames
the block by ``Content-Length`` and checks the block's and the payload's digest; it never holds more than one record, and
without ``with_payload`` not even that.  A damaged member gives a row with ``error`` and reading goes on at the next one.

Pages with equal payloads are written once, as the response of the largest id, and as revisits that name its record.
Equal payloads meet through a pre-aggregated maximum per digest and a join that adaptive execution can split.

A task writes to names of its own attempt and reports them; only files of reported (that is, successful) attempts are in
the manifest, which is a written table.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from adlumen.llm.common import scratch, small_batches, stored

CHUNK = 1 << 16
ROLL = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6f1d3a52-6c1e-5c0e-9d0b-0a4c5f1e7b21")
_READ = (
    "path string, member long, record_id string, record_type string, uri string, page_id long, refers_to_record string, payload_digest string, "
    "payload_bytes long, block_bytes long, verified boolean, error string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _line(value: str | None) -> str:
    """A header value on one line."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def page_member(page_id: int | None, uri: str | None, payload: bytes, response_id: int | None, revisit: bool) -> bytes:
    digest = base32_sha1(payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Target-URI", _line(uri)),
        ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(response_id, digest))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(headers, http if revisit else http + payload)


def written(pages: DataFrame, folder: str, least_bytes: int = 0, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Write a record per row and return the manifest: ``path, records, bytes`` of each archive in ``folder``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the largest id is the response.  A null
    payload is an empty one; rows without id are responses only where no row with an id has their payload; rows that repeat
    the largest id are responses all.  An empty table gives no archive.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(uri_column).cast("string").alias("uri"),
        F.coalesce(F.col(payload_column).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    equal = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    typed = rows.join(equal.filter("n > 1").select("digest", "response_id"), "digest", "left").select(
        "page_id", "uri", "payload", "response_id", (F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))).alias("revisit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        attempt, done, out = uuid.uuid4().hex, [], None
        path, records, size = "", 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append((path, records, size))

        for batch in batches:
            for page_id, uri, payload, response_id, revisit in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None or size >= ROLL:
                    close()
                    path, records, size = f"{attempt}-{len(done):05d}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{path}", compression=None)
                data = page_member(page_id, uri, payload.encode(), response_id, revisit)
                out.write(data)
                records, size = records + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            names=["path", "records", "bytes"],
        )

    return stored(typed.mapInArrow(run, "path string, records long, bytes long"))


class _Member:
    """Parses one record while it is inflated: header lines, then ``Content-Length`` bytes of block, then two line ends."""

    def __init__(self, keep: bool):
        self.head, self.headers, self.keep = bytearray(), None, keep
        self.left = self.block_bytes = self.payload_bytes = 0
        self.block, self.payload, self.http, self.body = hashlib.sha1(), hashlib.sha1(), bytearray(), bytearray()
        self.in_payload, self.tail = False, bytearray()

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                if len(self.head) > 1 << 20:
                    raise ValueError("header too long")
                return
            lines = bytes(self.head[:end]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            self.left = int(self.headers["content-length"])
            self.is_http = self.headers.get("content-type", "").startswith("application/http")
            self.in_payload = not self.is_http
            data, self.head = bytes(self.head[end + 4 :]), bytearray()
        part, rest = data[: self.left], data[self.left :]
        self.left -= len(part)
        self.block_bytes += len(part)
        self.block.update(part)
        if not self.in_payload:
            self.http += part
            end = self.http.find(b"\r\n\r\n")
            if end >= 0:
                self.in_payload, part = True, bytes(self.http[end + 4 :])
                del self.http[end:]
            else:
                part = b""
        self.payload.update(part)
        self.payload_bytes += len(part)
        if self.keep:
            self.body += part
        self.tail += rest
        if len(self.tail) > 4:
            raise ValueError("block longer than its Content-Length")

    def row(self, path: str, number: int) -> tuple:
        if self.headers is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("record shorter than its Content-Length")
        h = self.headers
        revisit = h.get("warc-type") == "revisit"
        given = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        found = base64.b32encode(self.payload.digest()).decode()
        block = h.get("warc-block-digest", "").removeprefix("sha1:")
        # The payload of a revisit is that of the record it refers to.
        good = block in ("", base64.b32encode(self.block.digest()).decode()) and (revisit or given in (None, found))
        page = h.get("x-page-id")
        return (
            path, number, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), int(page) if page else None, h.get("warc-refers-to"),
            given if revisit else found, None if revisit else self.payload_bytes, self.block_bytes, good, None if good else "digest differs",
            bytes(self.body) if self.keep and not revisit else None,
        )


def records(stream, path: str, with_payload: bool = False) -> Iterator[tuple]:
    """Rows of ``_READ`` for every member of an open file."""
    data, number, ended = b"", 0, False

    def more() -> bool:
        nonlocal data, ended
        chunk = stream.read(CHUNK)
        data, ended = data + chunk, not chunk
        return not ended

    while data or more():
        z, record, error, pending, fresh = zlib.decompressobj(31), _Member(with_payload), None, False, True
        while not z.eof:
            if not data and not pending and not more():
                error = error or "member ends early"
                break
            try:
                text = z.decompress(data, CHUNK)
            except zlib.error as e:
                # Go on at the next member, if there is one: not at the first byte of this one.
                error, data = error or str(e), data[1:] if fresh else data
                while (at := data.find(b"\x1f\x8b\x08")) < 0 and more():
                    data = data[-(CHUNK + 2) :]
                data = data[at:] if at >= 0 else b""
                break
            fresh, pending = False, len(text) == CHUNK
            data = z.unused_data if z.eof else z.unconsumed_tail
            try:
                # A record that is framed badly is still inflated to its end.
                if error is None:
                    record.feed(text)
                if z.eof and error is None:
                    row = record.row(path, number)
            except (ValueError, KeyError) as e:
                error = f"{type(e).__name__}: {e}"
        yield (path, number, *[None] * 8, False, error, None) if error else row
        number += 1


def read(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """All records of the manifest's archives, one task for each file; see ``_READ``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        kinds = [pa.string(), pa.int64()] + [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in _READ.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{path}", compression=None, buffer_size=0) as stream:
                    out, size = [], 0
                    for row in records(stream, path, with_payload):
                        out.append(row)
                        size += len(row[-1] or b"") + 300
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    files = manifest.count()
    return manifest.select("path").repartition(max(1, files), "path").mapInArrow(run, _READ)


def resolved(found: DataFrame) -> DataFrame:
    """Records with what revisits refer to: ``refers_to`` (page id), and length and digest of the full payload.

    A revisit whose response is missing or has another digest is not verified and has no length.
    """
    first = (
        found.filter("record_type = 'response' and error is null").groupBy("record_id")
        .agg(F.min("page_id").alias("to_page"), F.min("payload_bytes").alias("to_bytes"), F.min("payload_digest").alias("to_digest"))
        .withColumnRenamed("record_id", "refers_to_record")
    )
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    # Only revisits are joined: all others have no record to look for, and would meet in one task.
    joined = found.filter(revisit).drop("payload_bytes").join(first, "refers_to_record", "left")
    joined = joined.withColumn("verified", F.col("verified") & F.coalesce(F.col("to_digest") == F.col("payload_digest"), F.lit(False)))
    joined = joined.withColumnsRenamed({"to_page": "refers_to", "to_bytes": "payload_bytes"}).drop("to_digest")
    return found.filter(~revisit).withColumn("refers_to", F.lit(None).cast("long")).unionByName(joined)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to a new folder, read the archives and resolve the revisits."""
    folder = scratch(pages.sparkSession) + "-warc"
    return resolved(stored(read(written(pages, folder, **options), folder)))
