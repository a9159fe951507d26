"""WARC archives of pages: written and read back a record at a time."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.storage import Workspace

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes after which a task starts the next archive, and bytes that are read at a time.
ARCHIVE_BYTES, CHUNK = 256 << 20, 1 << 16
LEVEL = 3
#: Digests that are verified.
ALGORITHMS = {"sha1", "sha256", "sha384", "sha512", "md5"}
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "archive string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of page refers_to, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    gz = zlib.compressobj(LEVEL, wbits=31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def _members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The decompressed chunks of each gzip member."""
    rest = b""

    def chunks() -> Iterator[bytes]:
        nonlocal rest
        gz = zlib.decompressobj(wbits=31)
        while not gz.eof:
            data = rest or stream.read(CHUNK)
            if not data:
                raise ValueError("the archive ends within a record")
            yield gz.decompress(data, CHUNK)
            rest = gz.unconsumed_tail or gz.unused_data

    while rest or (rest := stream.read(CHUNK)):
        yield chunks()


def _head(buffer: bytearray, chunks: Iterator[bytes]) -> str:
    """Takes a header block off the stream, as long as its values are; what follows it stays in buffer."""
    seen = 0
    while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
        seen = len(buffer)
        if (more := next(chunks, None)) is None:
            raise ValueError("a header block has no end")
        buffer += more
    head = buffer[:end].decode("utf-8", "replace")
    del buffer[: end + 4]
    return head


def _fields(head: str) -> dict[str, str]:
    """Field names in lower case; a line that begins with white space goes on with the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", head).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


class _Digests:
    """The digests of a stream of bytes that a record asks for, and SHA-256."""

    def __init__(self, *labels: str | None):
        names = {label.partition(":")[0].lower().replace("-", "") for label in labels if label}
        self.own = {name: hashlib.new(name) for name in {"sha256", *(names & ALGORITHMS)}}

    def update(self, part: bytes) -> None:
        for digest in self.own.values():
            digest.update(part)

    def differs(self, label: str | None) -> bool:
        """Whether a digest, labelled and in hex or base 32, is another one; one of an unknown kind is not judged."""
        name, _, value = (label or "").partition(":")
        digest = self.own.get(name.lower().replace("-", ""))
        if digest is None:
            return False
        value = value.strip()
        if len(value) == 2 * digest.digest_size:
            return value.lower() != digest.hexdigest()
        return value.upper().rstrip("=") != base64.b32encode(digest.digest()).decode().rstrip("=")


class _Payload:
    """Splits a block into its HTTP header, if it has one, and its payload."""

    def __init__(self, http: bool):
        self.start = bytearray() if http else None

    def take(self, part: bytes) -> bytes:
        if self.start is None:
            return part
        seen = len(self.start)
        self.start += part
        if (at := re.compile(rb"\r?\n\r?\n").search(self.start, max(0, seen - 3))) is None:
            return b""
        rest, self.start = bytes(self.start[at.end() :]), None
        return rest


def read_records(stream: BinaryIO, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive, of every type and in order; a wrong frame or digest is an error.

    Any WARC 1 archive of one gzip member a record is read: digests may be
    missing, of another kind, in hex or base 32. payload_digest is the SHA-256
    of the payload as it stands in the archive, a revisit's the one it names.
    Of a record no more than its header and a chunk is held, unless its payload
    is asked for.
    """
    for chunks in _members(stream):
        buffer = bytearray()
        head = _head(buffer, chunks)
        if not head.startswith("WARC/1."):
            raise ValueError("a member doesn't begin with a WARC version")
        fields = _fields(head)
        if not re.fullmatch(r"\d+", fields.get("content-length", "")):
            raise ValueError("a record has no content length")
        length, kind = int(fields["content-length"]), fields.get("warc-type", "").lower()
        block_label, label = fields.get("warc-block-digest"), fields.get("warc-payload-digest")
        block, payload = _Digests(block_label), _Digests(label)
        split = _Payload(fields.get("content-type", "").lower().startswith("application/http"))
        seen, n, parts = 0, 0, []
        while True:
            part = bytes(buffer[: length - seen])
            del buffer[: length - seen]
            seen += len(part)
            block.update(part)
            part = split.take(part)
            payload.update(part)
            n += len(part)
            if with_payload:
                parts.append(part)
            if seen == length:
                break
            if (more := next(chunks, None)) is None:
                raise ValueError("a record is shorter than its content length")
            buffer += more
        for more in chunks:
            buffer += more
        if bytes(buffer) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its content length says")
        if block.differs(block_label):
            raise ValueError("a block has another digest than its record says")
        if kind != "revisit" and "warc-truncated" not in fields and payload.differs(label):
            raise ValueError("a payload has another digest than its record says")
        page = fields.get("x-page-id")
        yield {
            "page_id": None if page is None else int(page),
            "url": fields.get("warc-target-uri"),
            "payload_bytes": n,
            "payload_digest": (label or "").removeprefix("sha256:") or None if kind == "revisit" else payload.own["sha256"].hexdigest(),
            "record_type": kind,
            "record_id": fields.get("warc-record-id"),
            "refers_to_id": fields.get("warc-refers-to"),
        } | ({"payload": b"".join(parts)} if with_payload else {})


def _write_batches(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path)
        task, made, out = TaskContext.get(), [], None

        def close() -> None:
            nonlocal out
            out[0].close()
            # a task that runs again writes the same bytes under the same name
            fs.move(out[1], out[2])
            made.append((out[2], out[3], out[4]))
            out = None

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(5)), strict=True):
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    name = f"{path}/part-{task.partitionId():06d}-{len(made):04d}.warc.gz"
                    own = f"{name}.{task.taskAttemptId()}"
                    out = [fs.open_output_stream(own, compression=None), own, name, 0, 0]
                data = record(page_id, url, (html or "").encode(), digest, refers_to)
                out[0].write(data)
                out[3] += 1
                out[4] += len(data)
                if out[4] >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes rows of (page_id, url, html, digest, refers_to) under folder; a row of MANIFEST for each archive.

    folder is a URI that all executors reach: a file system that pyarrow opens.
    """
    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write_batches(folder), MANIFEST)


def _read_batches(folder: str, with_payload: bool) -> Callable:
    names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.int64()] + [pa.string()] * 4 + [pa.binary()] * with_payload

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(archive, compression=None) as stream:
                    for r in read_records(stream, with_payload):
                        rows.append(r)
                        size += 100 + len(r.get("payload", b""))
                        if size > 1 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    return run


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Rows of RECORDS, of every record type, from the archives of a table, an archive a task; with_payload adds the payload."""
    spread = archives.select("archive").repartition(max(1, min(archives.count(), 100_000)))
    return spread.mapInArrow(_read_batches(folder, with_payload), RECORDS + ", payload binary" * with_payload)


def digested(pages: DataFrame, least: int = LEAST_REVISIT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): the page that each one revisits, or null.

    Digests that occur more than once combine before the shuffle; the pages
    join them once, so a payload of a third of all pages is split by the join.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    refers = F.when((F.col("first") == F.col("page_id")), F.lit(None)).otherwise(F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def archived(pages: DataFrame, least: int = LEAST_REVISIT, **names: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages written to archives and read back.

    A null html is an empty payload. Of equal payloads of at least `least`
    bytes the smallest page_id is the response, rows that repeat it too; rows
    with a null page_id revisit it, and where all ids are null each is a
    response. A revisit's length comes from the response it refers to. Very long
    payloads are written whole and read in steps. An empty table gives no rows;
    other columns are not read.
    """
    ws = Workspace(pages.sparkSession, "warc")
    folder = f"{ws.path}/archives"
    folder = folder if re.match(r"\w+:", folder) else f"file://{folder}"
    manifest = ws.table(write_archives(digested(pages, least, **names), folder), "manifest")
    records = ws.table(read_archives(manifest, folder).drop("url"), "records")
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"))
    needed = records.where("record_type = 'revisit'").select("refers_to_id").distinct()
    responses = responses.join(needed, "refers_to_id", "left_semi").dropDuplicates(["refers_to_id"])
    out = records.join(responses, "refers_to_id", "left")
    length = F.when(F.col("record_type") == "revisit", F.col("_bytes")).otherwise(F.col("payload_bytes"))
    return out.select("page_id", length.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
