"""WARC archives: one gzip member per record, revisits for repeated payloads, a sequential reader.

The writer marks repeated payloads by digest before anything is written; each task then
streams its rows into one archive. The reader decompresses member by member as it goes,
cuts each record by its content length and verifies its digests, holding one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearfold.llm.common import attach, bounded_broadcast, small_batches
from clearfold.session import cut, shared_dir

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:clearfold:page:"
CHUNK = 1 << 16
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]  # names in lower case
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head of the block; empty in a revisit."""
        return self.block.partition(b"\r\n\r\n")[2]

    def http_header(self, name: str) -> str | None:
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            if key.strip().lower() == name.lower().encode():
                return value.strip().decode()
        return None

    def verified(self) -> bool:
        """Block digest, and for a response the payload digest, agree with the headers that are there."""
        own = {"warc-block-digest": self.block} | ({"warc-payload-digest": self.payload} if self.kind == "response" else {})
        return all(self.headers[k] == f"sha1:{digest(v)}" for k, v in own.items() if k in self.headers)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own; the content length is added."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(source) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, read in chunks."""
    data = source.read(CHUNK)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data:
                raise ValueError("the archive ends inside a member")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data if unpacker.eof else source.read(CHUNK)
        yield b"".join(parts)
        data = data or source.read(CHUNK)


def records(source) -> Iterator[Record]:
    """The records of an archive in order. A record cut short, or framed otherwise than it says, is an error."""
    for data in members(source):
        head, found, rest = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not found or not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        for line in lines[1:]:
            key, _, value = line.partition(b":")
            headers[key.strip().lower().decode()] = value.strip().decode()
        length = int(headers["content-length"])
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise ValueError("the content length does not frame the record")
        yield Record(headers, rest[:length])


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The member of a page: a response, or a revisit of ``refers_to`` that leaves the payload out."""
    name = lambda i: f"<{RECORD_URN}{'' if i is None else i}>"
    http = HTTP_HEAD.format(len(payload)).encode()
    block = http if refers_to is not None else http + payload
    target = quote(url, safe="/:?#[]@!$&'()*+,;=%~") if url else f"{RECORD_URN}{page_id}"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", target)]
    if refers_to is not None:
        headers += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    return member(headers, block)


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id``, ``payload`` and ``refers_to``: the largest id with the same payload, null for that one itself.

    Digests and ids are all that is shuffled. A payload that a third of all pages share is one
    row per task after partial aggregation, and its partition of the join is split by adaptive execution. A null payload is
    empty; a page without an id is always a response.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    hashed = cut(pages.select(F.col(id_col).cast("bigint").alias("id"), F.sha1(payload.cast("binary")).alias("sha")))
    shared = hashed.groupBy("sha").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    again = attach(hashed, cut(shared), ["sha"]).where(F.col("id") != F.col("refers_to"))
    revisits = cut(again.select("id", "sha", "refers_to").distinct())
    own = pages.select(F.col(id_col).cast("bigint").alias("id"), "url", payload.alias("payload")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    return own.join(bounded_broadcast(revisits), ["id", "sha"], "left").select("id", "url", "payload", "refers_to")


MANIFEST = "file string, n_records bigint"


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", html_col: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Write one archive per task and return the manifest, a written table with one row per archive.

    Files have names of their own and only the manifest says which count, so attempts that
    failed leave nothing that is read. An empty table gives no archives. ``folder`` is a URI
    that pyarrow can write (default: a new one in the shared folder).
    """
    small_batches(pages.sparkSession)
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, uri = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to"))):
                if out is None:
                    own, at = pafs.FileSystem.from_uri(uri)
                    out = own.open_output_stream(at, compression=None)
                out.write(page_record(page_id.as_py(), url.as_py(), payload.as_py().encode(), refers_to.as_py(), date))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["file", "n_records"])

    return cut(with_revisits(pages, id_col, html_col).mapInArrow(write, MANIFEST))


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, verified boolean"


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives, each read by one task.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload also for a revisit,
    from the HTTP head and the digest header that it keeps; ``verified`` says that all digests
    that can be recomputed agree.
    """
    n = max(1, manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism)

    def ident(name: str | None) -> int | None:
        tail = (name or "").strip("<>").removeprefix(RECORD_URN)
        return int(tail) if tail else None

    def row(r: Record) -> tuple:
        size = len(r.payload) if r.kind == "response" else int(r.http_header("content-length") or 0)
        said = r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
        return ident(r.headers.get("warc-record-id")), size, said, r.kind, ident(r.headers.get("warc-refers-to")), r.verified()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(archive["file"])
                rows, n_records = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for r in records(source):
                        rows.append(row(r))
                        n_records += 1
                        if len(rows) == 10_000:
                            yield _columns(rows)
                            rows = []
                if n_records != archive["n_records"]:
                    raise ValueError(f"{archive['file']} has not the records its manifest names")
                if rows:
                    yield _columns(rows)

    return manifest.repartitionByRange(n, "file").mapInArrow(read, READ)


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    names = [c.split()[0] for c in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
